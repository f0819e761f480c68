"""Personal data: patterns propose spans, checksums confirm them, context scores them.

Everything is DataFrame expressions; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm._common import free_name

#: The kinds in the order in which spans are listed; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE = KINDS[:4]

#: Marks put into a working copy of the text, one character for one character,
#: so that offsets stay. Texts that hold them already get \u0003 in their place.
_OPEN, _CLOSE, _OTHER, _SEP, _DOT = "\u0001", "\u0002", "\u0003", "\u0004", "\u0005"

#: Java patterns over the marked copy. Runs are single character classes, which
#: Java matches in a loop (a repeated group would recurse and overflow the stack
#: on very long runs); a match may begin at the start of its run or where the
#: match before it ended, which is where a leftmost scan can begin.
PATTERNS = {
    "email": rf"(?:(?<![A-Za-z0-9._%+\x05-])|\G)[A-Za-z0-9._%+\x05-]++@[A-Za-z0-9-]++\x05[A-Za-z0-9\x05-]*+",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9][0-9\x04]++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9+/_-])(?:-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----|[A-Za-z0-9+/_-]{20,}+={0,2}+)",
}
#: Score of a span without context, and the words, in the languages of the corpus, that
#: raise it when one of them stands, as a word of its own, within CONTEXT_CHARS before it.
SCORES = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.5, "iban": 0.7, "ssn": 0.3, "secret": 0.3}
CONTEXT = {
    "email": "e-?mail|mail|contact|contacto|kontakt|courriel|correo|write|escriba|schreiben|écrire",
    "ip": "ip|ipv4|address|adresse|dirección|host|server|servidor|serveur",
    "card": "card|visa|mastercard|credit|payment|karte|kreditkarte|carte|tarjeta|pago|paiement",
    "phone": "phone|tel|telephone|call|mobile|fax|telefon|handy|téléphone|teléfono|móvil|portable",
    "iban": "iban|bank|account|konto|compte|cuenta|banque|banco",
    "ssn": "ssn|social security|sozialversicherung|sécurité sociale|seguridad social",
    "secret": "token|secret|password|passwd|pwd|passwort|contraseña|bearer|(?:api|access|private|secret)[ _-]?key",
}
CONTEXT_CHARS, CONTEXT_GAIN, THRESHOLD = 40, 0.3, 0.5
#: Openings by which published kinds of keys are known; such a span needs no context.
ISSUED = r"^(?:-----BEGIN|AKIA[0-9A-Z]{16}$|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-)"


def _parts(text: Column, kind: str) -> Column:
    """What stands before the first match, then each match with what follows it."""
    return F.split(F.regexp_replace(text, PATTERNS[kind], f"{_OPEN}$0{_CLOSE}"), _OPEN, -1)


def _spans(parts: Column) -> Column:
    """The matches as (start, end, body); code points, end exclusive."""
    kept = "array<struct<start:int,end:int,body:string>>"

    def step(state: Column, part: Column) -> Column:
        body = F.substring_index(part, _CLOSE, 1)
        at = state["pos"]
        span = F.struct(at.alias("start"), (at + F.char_length(body)).alias("end"), body.alias("body"))
        return F.struct((at + F.char_length(part) - 1).alias("pos"), F.concat(state["out"], F.array(span)).alias("out"))

    zero = F.struct(F.char_length(parts[0]).alias("pos"), F.array().cast(kept).alias("out"))
    found = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), zero, step, lambda s: s["out"])
    return F.when(F.size(parts) > 1, found).otherwise(F.array().cast(kept))


def _digits(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def weighed(i: Column) -> Column:
        d = F.substr(back, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    total = F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), lambda a, i: a + weighed(i))
    return total % 10 == 0


def _mod97(body: Column) -> Column:
    turned = F.concat(F.substr(body, F.lit(5), F.lit(40)), F.substr(body, F.lit(1), F.lit(4)))

    def step(a: Column, i: Column) -> Column:
        c = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(c < 65, (a * 10 + c - 48) % 97).otherwise((a * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(body)), F.lit(0), step) == 1


def _valid(kind: str, body: Column) -> Column:
    if kind == "ip":
        small = lambda p: F.char_length(F.regexp_replace(p, "^0+", "")) <= 3
        return F.forall(F.split(body, r"\."), lambda p: F.when(small(p), p.substr(-3, 3).cast("int") <= 255).otherwise(False))
    if kind == "card":
        digits = _digits(body)
        return F.when(F.char_length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.char_length(_digits(body)).between(8, 15)
    if kind == "iban":
        return _mod97(body)
    if kind == "secret":  # a digit and a letter in it, or a header of a private key
        return body.rlike("^-----BEGIN") | (body.rlike("[0-9]") & body.rlike("[A-Za-z]"))
    return F.lit(True)


def find(docs: DataFrame, text: str = "text", out: str = "pii", threshold: float = THRESHOLD) -> DataFrame:
    """Add ``out``: array of (kind, start, end, score), by kind as in KINDS, then start.

    Spans of a kind do not overlap and are the leftmost ones; those that fail
    their check (octets, Luhn, digit count, mod-97) are dropped without another
    try. Base kinds stay whatever their score; the further kinds (iban, ssn, secret)
    need ``threshold``. Null or empty text: an empty array. Repeated rows are each
    treated alike; other columns pass through, whatever their names, but a column
    named ``out`` is replaced. Texts are read whole; linear in the text, but a span's
    position costs the spans before it in the same document.
    """
    mark = free_name(docs, "__pii_")
    clean = F.translate(F.coalesce(F.col(text), F.lit("")), _OPEN + _CLOSE + _SEP + _DOT, _OTHER * 4)
    df = docs.withColumn(f"{mark}t", clean)
    whole = F.col(f"{mark}t")
    # a separator between digits, a dot between domain characters
    carded = F.regexp_replace(whole, r"(?<=[0-9])[\x20-](?=[0-9])", _SEP)
    dotted = F.when(F.contains(whole, F.lit("@")), F.regexp_replace(whole, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", _DOT)).otherwise("")
    source = {"email": dotted, "card": carded}
    # one projection for each step: the optimizer keeps them apart, so that no pattern runs twice
    df = df.withColumns({f"{mark}{k}": _parts(source.get(k, whole), k) for k in KINDS})
    df = df.withColumns({f"{mark}{k}": _spans(F.col(f"{mark}{k}")) for k in KINDS})

    def scored(kind: str) -> Column:
        def one(s: Column) -> Column:
            begin = F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0))
            near = F.lower(F.substr(whole, begin + 1, s["start"] - begin))
            score = F.lit(SCORES[kind]) + F.when(near.rlike(rf"(?<![\p{{L}}])(?:{CONTEXT[kind]})(?![\p{{L}}])"), CONTEXT_GAIN).otherwise(0.0)
            if kind == "secret":
                score = score + F.when(s["body"].rlike(ISSUED), CONTEXT_GAIN).otherwise(0.0)
            return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.least(score, F.lit(1.0)).alias("score"))

        found = F.transform(F.filter(F.col(f"{mark}{kind}"), lambda s: _valid(kind, s["body"])), one)
        return found if kind in BASE else F.filter(found, lambda s: s["score"] >= threshold - 1e-9)

    some = F.size(F.concat(*[F.col(f"{mark}{k}") for k in KINDS])) > 0
    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    df = df.withColumn(out, F.when(some, F.concat(*[scored(k) for k in KINDS])).otherwise(none))
    return df.drop(f"{mark}t", *[f"{mark}{k}" for k in KINDS])


def redact(docs: DataFrame, text: str = "text", spans: str = "pii") -> DataFrame:
    """Replace each span of ``spans`` by its kind in brackets; a span that begins
    inside the one before it goes with that one. Null text stays null."""
    order = F.array_sort(F.transform(F.col(spans), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("e"), s["kind"].alias("kind"))))

    def step(state: Column, s: Column) -> Column:
        end = -s["e"]
        inside = s["start"] < state["pos"]
        gap = F.substr(F.col(text), state["pos"] + 1, s["start"] - state["pos"])
        label = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(
            F.greatest(state["pos"], end).alias("pos"),
            F.when(inside, state["out"]).otherwise(F.concat(state["out"], F.array(F.concat(gap, label)))).alias("out"),
        )

    zero = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))
    ended = lambda s: F.concat(F.array_join(s["out"], ""), F.substr(F.col(text), s["pos"] + 1, F.char_length(F.col(text))))
    return docs.withColumn(text, F.when(F.size(spans) > 0, F.aggregate(order, zero, step, ended)).otherwise(F.col(text)))
