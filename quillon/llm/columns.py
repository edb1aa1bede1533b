"""Column expressions that several operators share. All run inside the JVM."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
#: Smallest long: stands for a null doc_id, so that a null sorts before every id.
NO_ID = -(2**63)


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once a row: inside a lambda an outer expression is computed for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def words(text: Column) -> Column:
    """The maximal runs of other characters than space and tab to carriage return; none for a null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, as the near-duplicate operators compare them; none for a null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{M}\\p{N}]+"), lambda w: w != "")


def token_hashes(text: Column) -> Column:
    """A 64-bit hash for each of ``tokens``."""
    return F.transform(tokens(text), lambda w: F.xxhash64(w))


def lines(text: Column) -> Column:
    """The text split at newlines; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case and nothing else changed."""
    bare = F.btrim(line, F.lit(SPACE))
    plain = F.octet_length(bare) == F.length(bare)  # ASCII only: lower() changes A-Z alone
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Two non-null longs that are equal for equal (doc_id, text) and differ otherwise."""
    return [F.coalesce(doc_id.cast("long"), F.lit(NO_ID)).alias("__q_id"), F.xxhash64(doc_id.cast("long"), text).alias("__q_row")]


ROW = ["__q_id", "__q_row"]
#: Holds all columns of a document while an operator works on it, so that no name of its own can meet one of theirs.
DOC = "__q_doc"


def with_row_key(bare: DataFrame) -> DataFrame:
    """``bare``, of which the caller has chosen the columns, with those of ``row_key``."""
    a, b = row_key(bare["doc_id"], bare["text"])
    return bare.withColumns({"__q_id": a, "__q_row": b})


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def packed(docs: DataFrame) -> DataFrame:
    """The row key and ``DOC``, a struct of all columns of ``docs``, whatever their names."""
    return docs.select(*row_key(F.col("doc_id"), F.col("text")), F.struct(*(F.col(_quoted(c)) for c in docs.columns)).alias(DOC))


def unpacked(rows: DataFrame, **changed: Column) -> DataFrame:
    """The columns in ``DOC``, those in ``changed`` with other values; a changed column that is not there is left out."""
    fields = rows.schema[DOC].dataType.fields
    return rows.select(*((changed[f.name].cast(f.dataType) if f.name in changed else F.col(DOC)[f.name]).alias(f.name) for f in fields))


def kept_lines(text: Column, drop: Column) -> Column:
    """The array of lines left when those at the sorted positions ``drop``, from 0, go: slices between them, in one pass; all where it is null."""

    def cut(every, gone):
        n = F.size(gone)

        def between(i):
            start = F.when(i == 0, F.lit(0)).otherwise(F.get(gone, i - 1) + 1)
            stop = F.when(i == n, F.size(every)).otherwise(F.get(gone, i))
            return F.slice(every, start + 1, stop - start)

        return F.flatten(F.transform(F.sequence(F.lit(0), n), between))

    return let(lines(text), lambda every: F.when(drop.isNull(), every).otherwise(let(drop, lambda gone: cut(every, gone))))


def without_lines(rows: DataFrame, drop: Column) -> DataFrame:
    """The documents of ``packed`` rows without the lines at ``drop``; n_chars, if there, is counted anew. A text that keeps all its lines, or is null, stays as it is."""
    text = F.col(DOC)["text"]
    rows = rows.withColumn("__q_text", F.when(drop.isNotNull(), F.array_join(kept_lines(text, drop), "\n")).otherwise(text))
    names = rows.schema[DOC].dataType.names
    more = {"n_chars": F.when(drop.isNotNull(), F.length("__q_text")).otherwise(F.col(DOC)["n_chars"])} if "n_chars" in names else {}
    return unpacked(rows, text=F.col("__q_text"), **more)
