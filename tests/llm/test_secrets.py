"""Secret scan against Python's own matching, and the trigram queries."""

import hashlib
import random
import re

from tallyspark.llm import common, secret_scan as ss

BASE = [  # kind, pattern, measured group, least length
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
]


def by_hand(text):
    found = []
    for n, (kind, pattern, group, least) in enumerate(BASE):
        found += [(m.start(), n, m.end(), kind) for m in re.finditer(pattern, text or "") if len(m.group(group)) >= least]
    found.sort()
    joined = ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in found)
    counts = [sum(f[3] == b[0] for f in found) for b in BASE]
    return (*counts, hashlib.sha256(joined.encode()).hexdigest(), joined)


def texts():
    rng = random.Random(9)
    parts = [
        "password", "PassWd", "secret", "token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "abcdefgh", "Ab1+/_.=-9", "é", "漢", "\U0001F600",
        "AKIA", "ABCDEFGHIJKL", "Z9", "0123456789abcdef", "deadbeef", "g", "\n", "secret=", "token: key", "hunter2hunter2",
    ]
    out = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    return [None, "", *out, "x" * 70_000 + "token=abcdefgh" + "0f" * 40_000]


def test_base_spans(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, rule long").repartition(4)
    got = {r.doc_id: tuple(r)[1:] for r in ss.find_secrets(docs, more_rules=[]).collect()}
    assert got == {i: by_hand(t) for i, t in rows}


def test_added_rules_keep_base_spans(odd_docs, spark):
    token = "ghp_" + "a1B2" * 9
    docs = spark.createDataFrame([(1, f"é {token} password={'x' * 9} -----BEGIN RSA PRIVATE KEY-----"), (1, "other")], "doc_id long, text string")
    got = sorted(map(tuple, ss.find_secrets(docs).collect()), key=lambda r: r[-1])
    assert got[0] == (1, *by_hand("other"))
    assert got[1][5] == "github:2:42,assign:43:61,private_key:62:93" and got[1][4] == hashlib.sha256(b"assign:43:61").hexdigest()
    assert ss.find_secrets(odd_docs).count() == odd_docs.count()


def test_rows_without_an_id_are_spread_and_flagged_one_by_one(spark):
    """Rows of one id, or of none, have their own candidate rules; the join deals them by text as well."""
    found = [f"x {n} AKIAABCDEFGHIJKL{n:04d}" if n % 3 == 0 else f"y {n}" for n in range(60)]
    docs = spark.createDataFrame([(i, t) for t in found for i in (None, 9)], "doc_id long, text string")
    got = ss.find_secrets(docs)
    assert sorted((r.doc_id or 0, r.n_access) for r in got.collect()) == sorted((i, int(n % 3 == 0)) for n in range(60) for i in (0, 9))
    candidates = ss._candidates(docs, ss.BASE_RULES, "doc_id", "text", common.scratch(spark))
    assert candidates.count() == 40 and candidates.filter("rules != array('access')").isEmpty()


def test_empty(no_docs):
    assert ss.find_secrets(no_docs).collect() == []


def test_rules_without_trigrams_alone(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    assert ss._candidates(docs, [ss.BASE_RULES[2]], "doc_id", "text", "/unused") is None


def test_trigram_queries():
    tri = lambda s: frozenset(s[i : i + 3] for i in range(len(s) - 2))
    assert ss.trigram_query(ss.BASE_RULES[2].pattern) == []
    assert ss.trigram_query("AKIA[A-Z0-9]{12,}") == [tri("akia")]
    assert set(ss.trigram_query(ss.BASE_RULES[0].pattern)) == {tri(w) for w in ("password", "passwd", "secret", "token", "api_key", "apikey")}
    assert set(ss.trigram_query("ab?cd(ef|gh)+xyz")) == {tri("abcd") | tri("xyz"), tri("acd") | tri("xyz")}
    assert ss.trigram_query("(abc|d)e*") == [] and ss.trigram_query("(abc)*") == []
    assert ss.trigram_query("(?i:TOKEN)") == [tri("token")]


def test_queries_never_lose_a_match():
    rng = random.Random(11)
    patterns = [r.pattern for r in ss.BASE_RULES + ss.MORE_RULES] + [r"ab?cd(ef|gh)+xyz", r"(foo|ba[rz])-?\d{2}"]
    pieces = ["abcdefxyz", "acdghefxyz", "foo-12", "bar34", "baz-99", "AKIA" + "A1" * 6, "password=abcdefgh", "Secret : 12345678", "xoxb-" + "1" * 20, "CLÉ-1234"]
    patterns.append("CLÉ-[0-9]{4}")
    for _ in range(300):
        text = "".join(rng.choice(pieces) for _ in range(3))
        low = "".join(c.lower() if c.isascii() else c for c in text)
        grams = {low[i : i + 3] for i in range(len(text) - 2)}
        for p in patterns:
            query = ss.trigram_query(p)
            if re.search(p, text) and query:
                assert any(q <= grams for q in query), (p, text)


def test_rules_beyond_ascii_and_beyond_this_parser(spark):
    """Through the whole operator: capitals that the index does not fold, folding of all letters, and Java's own syntax."""
    rules = [
        ss.Rule("key", "CLÉ-[0-9]{4}"), ss.Rule("folded", "(?iu)straße-[0-9]{4}"), ss.Rule("upper", r"\p{Lu}{4}-[0-9]{4}"),
        ss.Rule("plain", "(?i)dağ[0-9]{2}xyz")]
    texts = ["xx CLÉ-1234 yy", "clé-1234", "STRASSE-1234 STRAßE-1234 Straße-9999", "ÀÉÎÕ-1234", "DAğ12XYZ dağ34xyz DAĞ56XYZ", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in ss.find_secrets(docs, more_rules=rules).collect()}
    assert got == {
        0: "key:3:11", 1: "", 2: "upper:3:12,folded:13:24,folded:25:36", 3: "upper:0:9", 4: "plain:0:8,plain:9:17", 5: "", 6: ""}
