"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph is a line that is not blank, without the white space around it. It is hashed to a wide
vector, and a document's fingerprint is the sum over its paragraphs, lane by lane modulo a power of
two. So the order of paragraphs is irrelevant, and adding or removing one adds or subtracts its
vector (``combine``), without reading the rest of the document. The vector has two parts:

* identity: 16 lanes modulo 2^31 and 2^30, hashed from the whole paragraph, two to a long;
* likeness: 126 lanes modulo 2^20, three to a long. Each counts the word pairs of the paragraph (two
  words one after the other; a paragraph of one word counts as it is) whose hash has that lane's bit set.

Documents with the same multiset of paragraphs have equal fingerprints. Others differ unless sums of their
hashes agree in all 488 bits, which chance does not bring about but somebody might: the hashes are not
cryptographic. The likeness of two fingerprints is the cosine of their likeness lanes after half
the number of pairs is taken off, an estimate (standard deviation at most 0.09, less for like texts) of the
cosine of the two multisets of word pairs. Negative estimates count as 0; equal fingerprints have likeness 1.

DataFrame functions only; no row is exploded, and texts are shuffled once.

Null text: empty. Empty text: all lanes 0. Null document ids come first in the order, rows of the
same id in the order of their texts. Very long texts: whole in their row; from 2^20 word pairs on a lane may
wrap, which changes no equality and makes their likeness smaller. Empty table: no rows. Other columns
are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from walletlens.session import materialize

#: Longs of the identity part and of each of the two hashes of the likeness part.
IDENTITY_LONGS = 8
VOTE_LONGS = 21
#: Ids that agree but for so many low bits are in one window of the order of documents.
RUN_BITS = 7
#: Hashes whose bits are added in fields of three bits.
GROUP = 7

_IDENTITY_MASK = ((1 << 30) - 1) << 32 | ((1 << 31) - 1)
_VOTE_BITS = 1 << 42 | 1 << 21 | 1
_THIRD_BITS = sum(1 << 3 * k for k in range(21))
_GROUP_BITS = GROUP * _VOTE_BITS
_VOTE_MASK = ((1 << 20) - 1) * _VOTE_BITS
_BLANK = r"[ \t\r\f\x0b]+"
_NO_ID = -(1 << 62)


def _not_blank(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda x: F.trim(x, F.lit(" \t\r\f\x0b"))), lambda x: x != "")


def _sum(items: Column, value, mask: int) -> Column:
    return F.aggregate(items, F.lit(0).cast("long"), lambda total, x: (total + value(x)).bitwiseAND(F.lit(mask)))


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _identity(paragraphs: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(IDENTITY_LONGS - 1)),
        lambda k: _sum(paragraphs, lambda p: F.xxhash64(k, p).bitwiseAND(F.lit(_IDENTITY_MASK)), _IDENTITY_MASK),
    )


def _votes(hashes: Column) -> Column:
    """The number of hashes with each bit set: long k holds bits k, k + 21 and k + 42.

    Every third bit of a few hashes is added as it stands, since three bits hold their number. The lanes then add up
    these sums, not single hashes.
    """
    groups = F.sequence(F.lit(0), (F.size(hashes) / GROUP).cast("int"))

    def added(group: Column, j: int) -> Column:
        part = F.slice(hashes, group * GROUP + 1, F.lit(GROUP))
        bits = F.lit(_THIRD_BITS)
        return F.aggregate(part, F.lit(0).cast("long"), lambda total, h: total + F.shiftright(h, j).bitwiseAND(bits))

    def lanes(sums: Column) -> Column:
        def lane(shift: Column) -> Column:
            return _sum(sums, lambda x: F.call_function("shiftright", x, shift).bitwiseAND(F.lit(_GROUP_BITS)), _VOTE_MASK)

        return F.transform(F.sequence(F.lit(0), F.lit(VOTE_LONGS - 3), F.lit(3)), lane)

    def third(j: int) -> Column:
        return _once(F.transform(groups, lambda g: added(g, j)), lanes)

    thirds = F.array(*(third(j) for j in range(3)))
    each = F.sequence(F.lit(0), F.lit(VOTE_LONGS // 3 - 1))
    return _once(thirds, lambda of: F.flatten(F.transform(each, lambda k: F.transform(of, lambda x: F.get(x, k)))))


def _word_pairs(paragraph: Column) -> Column:
    """Hashes of the pairs of neighbouring words of a paragraph that is not blank; of its word if it has one."""

    def pairs(words: Column) -> Column:
        more = F.size(words) - 1
        paired = F.zip_with(F.slice(words, F.lit(1), more), F.slice(words, F.lit(2), more), lambda a, b: F.xxhash64(a, b))
        return F.when(more > 0, paired).otherwise(F.transform(words, lambda a: F.xxhash64(a)))

    return _once(F.split(paragraph, _BLANK), pairs)


def _likeness_part(pieces: Column) -> Column:
    """Packed votes of two hashes of each piece, then the count of pieces."""

    def hashed(seed: int) -> Column:
        return F.transform(pieces, lambda p: F.xxhash64(F.lit(seed), p))

    count = F.array(F.size(pieces).cast("long"))
    return F.concat(_once(hashed(101), _votes), _once(hashed(102), _votes), count)


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text that is not null: longs of the identity, packed votes, count of pieces."""

    def parts(paragraphs: Column) -> Column:
        pairs = F.flatten(F.transform(paragraphs, _word_pairs))
        return F.concat(_identity(paragraphs), _once(pairs, _likeness_part))

    return _once(_not_blank(F.split(text, "\n")), parts)


def _identity_part(print_of: Column) -> Column:
    return F.slice(print_of, 1, IDENTITY_LONGS)


def _vote_part(print_of: Column) -> Column:
    return F.slice(print_of, IDENTITY_LONGS + 1, 2 * VOTE_LONGS)


def combine(left: Column, right: Column, sign: int = 1) -> Column:
    """The fingerprint of both multisets together (sign 1), or of the left without the right (sign -1)."""

    def lanes(part, mask: int, guard: int) -> Column:
        # A guard bit above each lane keeps a borrow from reaching the next lane.
        lift = F.lit(guard if sign < 0 else 0)
        return F.zip_with(part(left), part(right), lambda x, y: (x + lift + F.lit(sign) * y).bitwiseAND(F.lit(mask)))

    count = F.element_at(left, -1) + F.lit(sign) * F.element_at(right, -1)
    return F.concat(
        lanes(_identity_part, _IDENTITY_MASK, 1 << 62 | 1 << 31),
        lanes(_vote_part, _VOTE_MASK, _VOTE_BITS << 20),
        F.array(count),
    )


def _centred(print_of: Column) -> Column:
    """The likeness lanes less half the count of pieces."""
    lane = F.lit((1 << 20) - 1)
    half = F.element_at(print_of, -1) / F.lit(2.0)

    def spread(x: Column) -> Column:
        return F.array(*(F.shiftright(x, 21 * k).bitwiseAND(lane) - half for k in range(3)))

    return F.flatten(F.transform(_vote_part(print_of), spread))


def _product(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda total, term: total + term)


def likeness(left: Column, right: Column) -> Column:
    """Likeness of two fingerprints, 0 to 1."""

    def cosine(x: Column, y: Column) -> Column:
        size = F.sqrt(_product(x, x) * _product(y, y))
        return F.when(size > 0, _product(x, y) / size).otherwise(F.lit(0.0))

    near = _once(F.array(_centred(left), _centred(right)), lambda both: cosine(both[0], both[1]))
    return F.when(left == right, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), near)))


def shown(print_of: Column) -> Column:
    """A fingerprint as text: its longs in hex, 16 digits each."""
    return F.array_join(F.transform(print_of, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def _next_runs(heads: DataFrame) -> DataFrame:
    """(run, next_run) in ascending order, the last one's next is the first.

    Windows go over ranges of runs; only the first run of each range is ordered in a single task.
    """
    runs = materialize(heads.select("run").repartitionByRange("run").withColumn("part", F.spark_partition_id()), "runs")
    firsts = runs.groupBy("part").agg(F.min("run").alias("first"))
    order = Window.orderBy("part")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(order), F.first("first").over(whole)).alias("after"))
    later = F.lead("run").over(Window.partitionBy("part").orderBy("run"))
    return runs.withColumn("later", later).join(firsts, "part").select("run", F.coalesce("later", "after").alias("next_run"))


def with_next(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, text, print, next_text, next_print): each text beside that of the next id.

    A run of ids is one window. It holds one guest, the first text of the next run, so that its own
    last text finds what follows.
    """
    run = F.coalesce(F.shiftright("doc_id", RUN_BITS), F.lit(_NO_ID))
    rows = documents.select(
        F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")
    ).withColumn("run", run)
    heads = materialize(rows.groupBy("run").agg(F.min("doc_id").alias("head")), "fingerprint-heads")
    first = heads.select(F.col("run").alias("next_run"), "head")
    found = rows.join(first, (F.col("run") == F.col("next_run")) & F.col("doc_id").eqNullSafe(F.col("head")))
    found = found.groupBy("next_run").agg(F.min("text").alias("text"))
    guests = _next_runs(heads).join(found, "next_run")
    no_id = F.lit(None).cast("long")
    both = rows.select("run", "doc_id", "text", F.lit(False).alias("guest")).unionByName(
        guests.select("run", no_id.alias("doc_id"), "text", F.lit(True).alias("guest"))
    )
    both = both.withColumn("print", fingerprint(F.col("text")))
    order = Window.partitionBy("run").orderBy("guest", F.col("doc_id").asc_nulls_first(), "text")
    both = both.withColumn("next", F.lead(F.struct("text", "print")).over(order)).filter("NOT guest")
    return both.select(
        "doc_id", "text", "print", F.col("next.text").alias("next_text"), F.col("next.print").alias("next_print")
    )


def edited_fingerprints(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document its fingerprint, that of its edited text, and its likeness to it and to the next document.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many of the
    document with the next id (the last one's next is the first).
    """
    rows = with_next(documents, id_column, text_column).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2)
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")),
        F.substring(F.col("next_text"), F.lit(1), half.cast("int")),
    )
    rows = rows.withColumn("edited", edited).withColumn("edited_print", fingerprint(F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        shown(F.col("print")).alias("fingerprint"),
        shown(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
