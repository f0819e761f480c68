"""Personal data and token counts against plain Python."""

import hashlib
import re

import pytest

from fieldloom.llm import pii, queries, token_counts

SF = "/root/testdata/sf0.001"
RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def ok(kind, s):
    d = re.sub("[^0-9]", "", s)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda: 16 <= len(d) <= 19 and luhn(d),
        "phone": lambda: 8 <= len(d) <= 15,
    }[kind]()


def brute(text):
    return [(k, m.start(), m.end()) for k, r in RULES.items() for m in re.finditer(r, text) if ok(k, m.group())]


MORE = {
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9+/_-])(?:-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----|[A-Za-z0-9+/_-]{20,}={0,2})",
}


def brute_more(text):
    """The added kinds, with their checks and the words before them."""
    out = []
    for kind, rule in MORE.items():
        for m in re.finditer(rule, text):
            s = m.group()
            near = re.search(rf"(?<![^\W\d_])(?:{pii.CONTEXT[kind]})(?![^\W\d_])", text[max(0, m.start() - 40) : m.start()].lower())
            issued = re.match(r"-----BEGIN|AKIA[0-9A-Z]{16}$|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-", s)
            good = {
                "iban": lambda: int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1,
                "ssn": lambda: bool(near),
                "secret": lambda: (s.startswith("-----BEGIN") or (re.search("[0-9]", s) and re.search("[A-Za-z]", s))) and (near or issued),
            }[kind]
            if good():
                out.append((kind, m.start(), m.end()))
    return out


ODDITIES = [
    None, "", " ", "a@b.c_x@d.e @@ a@b. a@b..c .@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.00255 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1111-",
    "4111111111111111 1 4111  1111", "+1 (743) 555-3824 +12 +1-2-3-4-5-6-7-8. +1234567890123456", "\u0001a@b.c\u0002 \u0004 4\u00041", "é😀 x@y.zz 😀 1.1.1.1",
    "9" * 60_000, "1 " * 30_000, "a" * 50_000 + "@" + "b." * 20_000, "+" + "1(" * 20_000, "a@b.c " * 300, "DE89370400440532013000 iban DE89370400440532013001",
    "ssn 123-45-6789", "123-45-6789", "x@y.z\nx@y.z", "1" * 16 + "\n" + "2",
]


def test_spans_match_plain_python(spark):
    texts = ODDITIES + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, pii_extra string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.pii] for r in pii.find(df).collect()}
    for i, t in enumerate(texts):
        assert [s for s in got[i] if s[0] in pii.BASE] == brute(t or ""), (i, (t or "")[:80])
        assert [s for s in got[i] if s[0] not in pii.BASE] == brute_more(t or ""), (i, (t or "")[:80])
    extra = {i: [s for s in got[i] if s[0] not in pii.BASE] for i in got}
    assert extra[15] == [("iban", 0, 22)] and extra[16] == [("ssn", 4, 15)] and extra[17] == []


def test_context_secrets_and_clashing_columns(spark):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    texts = [
        f'token = "{key}"', f"commit {key}", "AKIA" + "A1" * 8, "-----BEGIN RSA PRIVATE KEY-----", "password: " + "a" * 30, "contraseña " + "a1" * 12,
        "shipped 1.2.3.4", "ip 1.2.3.4", "hotel +49 30 1234567", "Teléfono: +49 30 1234567", "x " * 30_000 + f"secret {key} " * 200,
    ]
    rows = [(i, t, "mine", 7, "own") for i, t in enumerate(texts)] + [(0, texts[0], "mine", 7, "own")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __t string, __email int, __pii_t string")
    out = pii.find(df)
    assert out.columns == [*df.columns, "pii"] and out.select(*df.columns).exceptAll(df).count() == 0
    got = {r.doc_id: [(s.kind, s.start, s.end, round(s.score, 2)) for s in r.pii] for r in out.collect()}
    assert out.count() == len(rows) and out.where("doc_id = 0").distinct().count() == 1
    assert got[0] == [("secret", 9, 49, 0.6)] and got[1] == [] and got[4] == []
    assert [got[k][0][0] for k in (2, 3, 5)] == ["secret"] * 3
    assert [got[k][0][3] for k in (6, 7, 8, 9)] == [0.5, 0.8, 0.5, 0.8]
    assert len(got[10]) == 200 and all(s[2] - s[1] == 40 for s in got[10])
    once = pii.redact(out.where("doc_id < 2")).select("doc_id", "text").distinct().collect()
    assert {r.doc_id: r.text for r in once} == {0: 'token = "[SECRET]"', 1: texts[1]}


def test_query_digest_and_redaction(spark):
    rows = queries.op6_pii(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join("%s:%d:%d" % s for s in want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in pii.BASE]
    df = spark.createDataFrame([(1, "to x@y.zz, +1 (743) 555-3824."), (2, None), (3, "clean")], "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.redact(pii.find(df)).collect()}
    assert out == {1: "to [EMAIL], [PHONE].", 2: None, 3: "clean"}
    assert pii.find(df.limit(0)).count() == 0


def test_token_counts_match_the_library(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_counts.default_path())
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += [None, "", "a<|endoftext|>b <|endoftext|>", "   x\n\n y\t\t", "՘ ͸ᱜ 𐥀𐥁", "日本語 1234 ½ ǅ", "x" * 30_000, "don't 'S 'll", "a 　b\x85\x1cc"]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in token_counts.count_tokens(df).collect()}
    for i, t in enumerate(texts):
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 1024), (i, (t or "")[:50])
    assert token_counts.count_tokens(df.limit(0)).count() == 0


def test_cache_is_bounded_without_changing_counts(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_ROWS", 5)
    a = token_counts.Lengths(token_counts.default_path(), {"a": 1})
    texts = ["one two three four five six seven", "one a"]
    assert a.counts(texts[:1]) + a.counts(texts[1:]) == [len(a.tokenizer.encode(t).ids) for t in texts]
    with pytest.raises(TypeError):
        a.counts([None])
