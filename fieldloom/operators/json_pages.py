"""Page records in JSON: lossless parsing, salvage of truncated text, spans of values."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A string literal, or a number outside of strings.
_NUMBER = r'("(?:[^"\\]|\\.)*+")|(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)'


def quote_numbers(text) -> Column:
    """Numbers outside of strings as string literals, so that 1234.50 keeps its last zero."""
    t = F.col(text) if isinstance(text, str) else text
    marked = F.regexp_replace(t, _NUMBER, '$1\u0001$2\u0001')
    return F.regexp_replace(F.regexp_replace(marked, "\u0001\u0001", ""), "\u0001", '"')


def is_object(text) -> Column:
    """Strictly valid JSON whose top level is an object."""
    t = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.schema_of_variant(F.try_parse_json(t)).startswith("OBJECT"), F.lit(False))


def parse_page(text, schema: str) -> Column:
    """``from_json`` with all leaves as printed; null for anything but a valid object."""
    t = F.col(text) if isinstance(text, str) else text
    return F.when(is_object(t), F.from_json(quote_numbers(t), schema))


#: A string, closed or cut off, or one bracket.
_STRUCTURE = re.compile(r'"(?:[^"\\]|\\.)*+(?:"|\\?\Z)|[{}\[\]]', re.S)


def salvage(text: str | None) -> str | None:
    """The longest valid prefix of truncated JSON: cut after the last complete nested
    container and close what is open. Null if there is no such cut, or where a bracket
    closes one of another kind: that is malformed, not truncated.

    Brackets outside of strings get a level, openers the depth they lead to and closers the
    one they leave; on each level openers and closers take turns.
    """
    if text is None:
        return None
    try:
        return text if isinstance(json.loads(text), dict) else None
    except ValueError:
        pass
    found = [m for m in _STRUCTURE.finditer(text) if m.group()[0] != '"']
    kinds = np.array(["{[}]".index(m.group()) for m in found], dtype=np.int64)
    depth = np.cumsum(np.where(kinds < 2, 1, -1))
    if not len(kinds) or depth.min() < 0:
        return None
    level = np.where(kinds < 2, depth, depth + 1)
    order = np.argsort(level, kind="stable")
    follows = np.flatnonzero(kinds[order] >= 2)  # each closer comes right after its opener
    if (kinds[order[follows]] - 2 != kinds[order[follows - 1]]).any():
        return None
    openers = np.flatnonzero(kinds < 2)
    for k in np.flatnonzero((kinds >= 2) & (depth > 0))[::-1].tolist():
        before = openers[openers < k]
        left = [kinds[before[level[before] == at][-1]] for at in range(int(depth[k]), 0, -1)]
        whole = text[: found[k].end()] + "".join("}]"[x] for x in left)
        try:
            return whole if isinstance(json.loads(whole), dict) else None
        except ValueError:
            continue
    return None


@F.pandas_udf(StringType())
def _salvage(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(salvage)


def salvaged(text) -> Column:
    """Valid text as it is; the salvage runs (in Arrow batches) on the rest only."""
    t = F.col(text) if isinstance(text, str) else text
    return F.when(is_object(t), t).otherwise(_salvage(F.when(~is_object(t), t)))


def expand_compact(page, schema: str = "dt string, h map<string,string>, r array<array<string>>, pk string", names=("supplier_part_number", "customer_part_number", "purchase_order", "quantity")) -> Column:
    """Positional rows to named ones; null if a row has another length."""
    p = parse_page(page, schema)
    rows = F.transform(p["r"], lambda r: F.struct(*[r[i].alias(n) for i, n in enumerate(names)]))
    return F.when(F.forall(p["r"], lambda r: F.size(r) == len(names)), F.struct(p["dt"].alias("doc_type"), p["h"].alias("header"), rows.alias("line_items"), p["pk"].alias("page_kind")))


def compact_rows(items, names=("supplier_part_number", "customer_part_number", "purchase_order", "quantity")) -> Column:
    return F.transform(items, lambda r: F.array(*[r[n] for n in names]))


def schema_errors(text, required: list[str]) -> Column:
    """Array of required:<key> and additional:<key>; values are never quoted."""
    t = F.col(text) if isinstance(text, str) else text
    keys = F.coalesce(F.json_object_keys(t), F.array().cast("array<string>"))
    want = F.array(*[F.lit(k) for k in required])
    tag = lambda a, n: F.transform(a, lambda k: F.concat(F.lit(f"{n}:"), k))
    return F.when(~is_object(t), F.array(F.lit("type:object"))).otherwise(F.concat(tag(F.array_except(want, keys), "required"), tag(F.array_except(keys, want), "additional")))


def value_spans(text: str | None) -> list[tuple[str, int, int, bool]]:
    """(path, start, end, complete) of the scalar values in JSON text that may be cut off;
    of repeated keys the last counts."""
    out: dict[str, tuple[int, int, bool]] = {}
    s, n = text or "", len(text or "")

    def blank(i: int) -> int:
        while i < n and s[i] in " \t\r\n":
            i += 1
        return i

    def string(i: int) -> tuple[int, bool]:
        i += 1
        while i < n:
            if s[i] == "\\":
                i += 2
                continue
            if s[i] == '"':
                return i + 1, True
            i += 1
        return n, False

    def value(i: int, path: str) -> int:
        i = blank(i)
        if i >= n:
            return n
        if s[i] in "{[":
            is_map, k, close = s[i] == "{", 0, "}" if s[i] == "{" else "]"
            i = blank(i + 1)
            while i < n and s[i] != close:
                name = str(k)
                if is_map:
                    if s[i] != '"':
                        return n
                    j, ok = string(i)
                    if not ok:
                        return n
                    name = s[i + 1 : j - 1]
                    i = blank(j)
                    if i >= n or s[i] != ":":
                        return n
                    i += 1
                i = blank(value(i, f"{path}.{name}" if path else name))
                k += 1
                if i < n and s[i] == ",":
                    i = blank(i + 1)
                elif i < n and s[i] != close:
                    return n
            return min(i + 1, n)
        if s[i] == '"':
            j, ok = string(i)
        else:
            j = i
            while j < n and s[j] not in ",}] \t\r\n":
                j += 1
            ok = j < n
        out[path] = (i, j, ok)
        return j

    value(0, "")
    return [(p, a, b, ok) for p, (a, b, ok) in out.items()]


def spans_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, start, end, complete): one row for each value in the text."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *s) for k, t in zip(pdf[key], pdf[text]) for s in value_spans(t)]
            yield pd.DataFrame(rows, columns=[key, "path", "start", "end", "complete"])

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, path string, start int, end int, complete boolean")


def span_logprobs(spans: DataFrame, tokens: DataFrame, key: str) -> DataFrame:
    """(key, path, min, mean, n): of the tokens (key, start, end, lp) that overlap a value's
    span; null if one of them is not finite. Equi-join on the document, interval test on top."""
    t = tokens.select(key, F.col("start").alias("t0"), F.col("end").alias("t1"), "lp")
    both = spans.join(t, key).where((F.col("t0") < F.col("end")) & (F.col("t1") > F.col("start")))
    finite = F.bool_and(F.coalesce(~F.isnan("lp") & (F.abs("lp") != float("inf")), F.lit(False)))
    agg = both.groupBy(key, "path").agg(finite.alias("ok"), F.min("lp").alias("lo"), F.avg("lp").alias("avg"), F.count("*").alias("n"))
    return agg.select(key, "path", F.when(F.col("ok"), F.bround("lo", 6)).alias("min"), F.when(F.col("ok"), F.bround("avg", 6)).alias("mean"), "n")
