"""Fill-in-the-middle transformation by an index of distinct texts.

Identical texts are grouped by the SHA-256 of their bytes and the texts themselves: each group is the set of its different texts, so that a copy is a copy by content. For each distinct
text the ends of its tokens, ``[A-Za-z]+|[^A-Za-z]`` over code points, are found once and kept as an Elias-Fano list: the low bits of each end in a row, the high bits in unary, some two bits
a token and the logarithm of a token's mean length. Documents are joined to the index by the hash, which the index has shown to name one text, and each seeded cut is one select
in the list of its text: no text is cut into tokens twice. Only the cuts are joined to the texts.

Texts are shuffled twice, to be grouped (copies meet before the shuffle) and to meet their cuts; a text that many documents share is one row of the index and, as a hot key, left to
Spark's splitting of skewed joins. The cuts are seeded by doc_id alone, so they are the same on any cluster.

Cases: a null text is empty, an empty text is plain with no token; a text with one of the marks is plain, as are ten in a hundred of the rest by their seed; a null doc_id
is seeded by an empty number; rows given twice are cut alike; texts of any length are read whole; other columns of the input are not read; an empty table gives an empty table. Two texts of one
SHA-256, should they ever be found, end the query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.spans import pieces
from quillon.session import discard, materialise, table

# The marks and the shares, in hundredths, of plain texts (from PLAIN on) and of those with the suffix first (below SUFFIX_FIRST).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, SUFFIX_FIRST = 90, 20
#: End of fixed values.
INDEX = "key binary, n long, low_bits int, low binary, high binary"
_INDEX = pa.schema([("key", pa.binary()), ("n", pa.int64()), ("low_bits", pa.int32()), ("low", pa.binary()), ("high", pa.binary())])
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1)


def token_ends(text: str) -> np.ndarray:
    """The end of each token, in code points: every place but those between two letters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = ((codes | np.uint32(32)) - np.uint32(97)) < 26
    return np.flatnonzero(~np.r_[letter[:-1] & letter[1:], False]) + 1 if len(codes) else np.zeros(0, np.int64)


def elias_fano(ends: np.ndarray) -> tuple[int, bytes, bytes]:
    """(low bits of a value, all low bits, the high parts in unary) of an increasing list."""
    if not len(ends):
        return 0, b"", b""
    bits = max(int(ends[-1]) // len(ends), 1).bit_length() - 1
    high = np.zeros((int(ends[-1]) >> bits) + len(ends), np.uint8)
    high[(ends >> bits) + np.arange(len(ends))] = 1
    low = (ends[:, None] >> np.arange(bits)) & 1
    return bits, np.packbits(low.astype(np.uint8).ravel()).tobytes(), np.packbits(high).tobytes()


def select(k: int, bits: int, low: bytes, high: bytes) -> int:
    """Value ``k`` of the list, from 1; 0 for the place before the first."""
    if k == 0:
        return 0
    packed = np.frombuffer(high, np.uint8)
    upto = np.cumsum(_ONES[packed])
    byte = int(np.searchsorted(upto, k))
    place = 8 * byte + int(np.flatnonzero(np.unpackbits(packed[byte : byte + 1]))[k - 1 - int(upto[byte]) + int(_ONES[packed[byte]])])
    first = (k - 1) * bits
    some = np.unpackbits(np.frombuffer(low, np.uint8)[first // 8 : (first + bits + 7) // 8])[first % 8 : first % 8 + bits]
    return ((place - k + 1) << bits) + int(some.astype(np.int64) @ (1 << np.arange(bits))) if bits else place - k + 1


def _key(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def index(docs: DataFrame) -> DataFrame:
    """(key, n, low_bits, low, high) of each distinct text of ``docs``, which has (doc_id, text); key is the text's SHA-256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            ends = [token_ends(t) for t in texts]
            lists = [elias_fano(e) for e in ends]
            columns = [batch.column(0), [len(e) for e in ends], *([x[i] for x in lists] for i in range(3))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, list) else c for c, f in zip(columns, _INDEX)], schema=_INDEX)

    text = F.coalesce("text", F.lit(""))
    same = docs.select(_key(text).alias("key"), text.alias("text")).groupBy("key").agg(F.collect_set("text").alias("texts"))
    one = F.when(F.size("texts") == 1, F.get("texts", 0)).otherwise(F.raise_error(F.lit("two texts have one SHA-256")).cast("string"))
    return same.select("key", one.alias("text")).mapInArrow(run, INDEX)


@F.pandas_udf(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())]))
def _places(a, b, bits, low, high):
    rows = [(select(i, k, x, y), select(j, k, x, y)) for i, j, k, x, y in zip(a, b, bits, low, high)]
    return pd.DataFrame(rows, columns=["a", "b"])


def seeds(doc_id: Column) -> list[Column]:
    """Four 32-bit numbers of a doc_id."""
    h = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def cuts(keyed: DataFrame, lists: DataFrame) -> DataFrame:
    """(doc_id, key, n, a, b) of each distinct (doc_id, key) of ``keyed``: where the prefix and the middle end, in code points, if the seed cuts the document. No text is needed."""
    found = keyed.select("doc_id", "key").distinct().join(lists, "key")
    h1, h2, h3, _ = seeds(F.col("doc_id"))
    first, second = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)

    def needed(value: Column, otherwise: Column) -> Column:
        return F.when(h3 % 100 >= PLAIN, otherwise).otherwise(value)  # a whole text needs no list

    start, none = F.lit(0).cast("long"), F.lit(b"")
    at = _places(needed(F.least(first, second), start), needed(F.greatest(first, second), start), "low_bits", needed(F.col("low"), none), needed(F.col("high"), none))
    return found.select("doc_id", "key", "n", at.alias("at")).select("doc_id", "key", "n", "at.a", "at.b")


def cut(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each row of ``docs``: ``output`` is the text, or its three parts behind their marks in the order of ``form``."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("key", _key(F.col("text")))
    lists = materialise(index(docs), "token-ends")
    at = materialise(cuts(rows, lists), "cuts")
    discard(lists)
    found = rows.join(at, rows["doc_id"].eqNullSafe(at["doc_id"]) & (rows["key"] == at["key"])).select(rows["doc_id"], "text", "n", "a", "b")
    _, _, h3, h4 = seeds(F.col("doc_id"))
    plain = (F.col("text") == "") | (h3 % 100 >= PLAIN)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | F.col("text").contains(mark)
    found = found.withColumn("form", F.when(plain, "plain").when(h4 % 100 < SUFFIX_FIRST, "spm").otherwise("psm"))
    a, b, whole = F.col("a"), F.col("b"), F.col("form") == "plain"
    p, m, s = F.substring("text", 1, a), F.substring("text", a + 1, b - a), F.substring("text", b + 1, F.length("text"))
    output = F.when(whole, F.col("text")).when(F.col("form") == "psm", F.concat(F.lit(PREFIX), p, F.lit(SUFFIX), s, F.lit(MIDDLE), m)).otherwise(F.concat(F.lit(SUFFIX), s, F.lit(PREFIX), p, F.lit(MIDDLE), m))
    return found.select("doc_id", "n", "form", F.when(~whole, a.cast("long")).alias("prefix_chars"), F.when(~whole, (b - a).cast("long")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that ``cut`` has made ``output`` of: the parts between the marks, which no text with a cut holds itself, put together in their order."""

    def parts(second: str) -> tuple[Column, Column, Column]:
        i, j = F.instr(output, second), F.instr(output, MIDDLE)
        return F.substring(output, 4, i - 4), F.substring(output, i + 3, j - i - 3), F.substring(output, j + 3, F.length(output))

    p, s, m = parts(SUFFIX)
    s2, p2, m2 = parts(PREFIX)
    return F.when(form == "psm", F.concat(p, m, s)).when(form == "spm", F.concat(p2, m2, s2)).otherwise(output)


def op11_fill_middle(spark, sf_dir):
    """doc_id, n, form, prefix_chars, middle_chars, and the hashes of the output and of the text restored from it, for each document."""
    out = cut(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


#: The same by lists of tokens.
ORACLE_SQL = f"""
with d as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
x as (select doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') as k, {", ".join(f"('0x' || substr(h, {8 * i + 1}, 8))::bigint as h{i + 1}" for i in range(4))} from d),
c as (select doc_id, t, k, len(k)::bigint as n, least(h1 % (len(k) + 1), h2 % (len(k) + 1)) as a, greatest(h1 % (len(k) + 1), h2 % (len(k) + 1)) as b,
  case when t = '' or contains(t, '{PREFIX}') or contains(t, '{SUFFIX}') or contains(t, '{MIDDLE}') or h3 % 100 >= {PLAIN} then 'plain' when h4 % 100 < {SUFFIX_FIRST} then 'spm' else 'psm' end as form from x),
p as (select doc_id, t, n, form, coalesce(array_to_string(k[1:a], ''), '') as p, coalesce(array_to_string(k[a + 1:b], ''), '') as m, coalesce(array_to_string(k[b + 1:], ''), '') as s from c)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m else '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m end) as output_sha256, sha256(t) as restored_sha256 from p
"""
