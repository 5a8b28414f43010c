"""Line dedup by chunks of adjacent lines, in DataFrame functions only.

A text is cut into units: lines, and sentences of a line, by all sentence
ends.  A unit of ``long_bytes`` or more is cut further at content-defined
places: after words where a rolling hash of the last two words is 0 modulo
``words``, so the same passage is cut alike wherever it stands.

Every unit with a word and the next one make a chunk, whose key is a rolling
hash over their hashes; a unit of over ``long_words`` words that no hash cut is
a chunk alone.  A chunk thus begins at every unit, so each repeated run of two
units or more consists of whole chunks, whatever stands around it: sparser
boundaries, chosen by the rolling hash, leave the ends of such a run standing.
A chunk found in several places keeps the first one (least document, then
position); the others go.  Runs shorter than ``min_chars`` stay.  Two chunks
are equal if their bytes are: the hashes find the repeated keys, and the units of
every chunk under such a key are compared.

Each text is cut once for its hashes, which are stored; text is cut again only
in documents with a repeated key.  Keys are counted before they are joined, and
both joins are hash joins, which sort no text and which Spark may split: they
build on the repeated keys (one row each) and on the chunks a document has of them.
The text is shuffled once: comparing and rebuilding read the same exchange.

Defined results: null and empty texts stay; text without a repeated chunk
stays byte for byte; ``n_chars``, where there is such a column, follows the
new text of changed rows; a text may become empty; rows equal in id and text
count as one document and keep their multiplicity; ids may be null, and come
first; columns of any name are kept.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import boxed, let, stored

# Scripts written without spaces; ends of sentences; ends of words.
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
ENDS, WIDE_ENDS = ("\n", ". ", "! ", "? "), ("… ", "。", "！", "？")
WORD = rf"(?<=[\s[\x{{E00}}-\x{{10FFFF}}&&[{UNSPACED}]]])(?=\S)"      # no such script below U+0E00: other letters are passed over fast
MARK = "\x01"


@dataclass(frozen=True)
class Params:
    min_chars: int = 40
    long_bytes: int = 300          # shortest sentence cut at words
    long_words: int = 50
    words: int = 16                # mean words between such cuts


def _bare(unit: Column) -> Column:
    return F.trim(unit, F.lit(" \t\r\n"))


def units(text: Column, p: Params = Params()) -> Column:
    """``array<string>``: lines, sentences and parts of long sentences, with what separates them."""
    def cut(word: Column) -> Column:
        def ends(h: Column) -> Column:
            return F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: (i == F.size(h) - 1) | (
                F.pmod(F.xxhash64(F.get(h, i - 1), F.get(h, i)), F.lit(p.words)) == 0))

        def build(e: Column) -> Column:
            return F.transform(e, lambda end, k: let(F.coalesce(F.get(e, k - 1) + 1, F.lit(0)), lambda first: F.array_join(
                F.slice(word, first + 1, end - first + 1), "")))
        return let(F.transform(word, lambda w: F.xxhash64(_bare(w))), lambda h: let(ends(h), build))

    # Marking the ends and splitting at the mark is several times cheaper than a pattern with lookarounds.
    def marked(t: Column, ends) -> Column:
        for end in ends:
            t = F.replace(t, F.lit(end), F.lit(end + MARK))
        return t
    near = marked(text, ENDS)
    near = let(near, lambda t: F.when(F.octet_length(t) > F.length(t), marked(t, WIDE_ENDS)).otherwise(t))
    pattern = "|".join(f"(?<={end})" for end in ENDS + WIDE_ENDS).replace("(?<=.", r"(?<=\.").replace("(?<=?", r"(?<=\?")
    sentences = F.when(F.contains(text, F.lit(MARK)), F.split(text, pattern)).otherwise(F.split(near, MARK))
    long = lambda s: F.octet_length(s) >= p.long_bytes
    parts = lambda s: F.when(long(s), let(F.split(s, WORD), cut)).otherwise(F.array(s))
    return let(sentences, lambda all: F.when(F.exists(all, long), F.flatten(F.transform(all, parts))).otherwise(all))


def _hash(t: Column) -> Column:
    return F.xxhash64(t)


def unit_hashes(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``a, b, u``: a document's key and, for each unit with a word, its place ``i``, hash ``h`` and whether it has ``many`` words."""
    def many(t: Column) -> Column:
        size = F.octet_length(t)
        return (F.when(size < 2 * p.long_words, F.lit(False))
                .when(size < p.long_bytes, size - F.octet_length(F.replace(t, F.lit(" "), F.lit(""))) >= p.long_words)
                .otherwise(F.size(F.split(t, WORD)) > p.long_words))

    def one(t: Column, i: Column) -> Column:
        return F.when(t != "", F.struct(i.alias("i"), _hash(t).alias("h"), many(t).alias("many")))

    u = F.filter(F.transform(F.transform(units(F.col("text"), p), _bare), one), lambda x: x.isNotNull())
    return docs.where(F.col("text") != "").select(*_key(), u.alias("u"))


def _key() -> list[Column]:
    """Identity of a row in two columns without nulls: its id, and 63 bits of the text's hash, odd for a null id."""
    id = F.col("doc_id").cast("long")
    return [F.coalesce(id, F.lit(0)).alias("a"), (F.shiftleft(F.xxhash64("text"), 1) + id.isNull().cast("int")).alias("b")]


def _start() -> Column:
    """A document's place 0; places are one number: id first, null ids before all others."""
    null = F.lit(Decimal(-2 ** 63 - 1)).cast("decimal(20,0)")
    whole = F.when(F.col("b").bitwiseAND(1) == 0, F.col("a").cast("decimal(20,0)")).otherwise(null)
    return (whole * F.lit(2 ** 31).cast("decimal(10,0)")).cast("decimal(31,0)")


def _place(start: Column) -> Column:
    return (start + F.col("at")).cast("decimal(32,0)")


def chunk_rows(hashes: DataFrame) -> DataFrame:
    """``a, b, start, at, to, key``: a document's first place, the units from ``at`` to ``to`` of each chunk, and its key."""
    near = hashes.select("a", "b", _start().alias("start"), F.explode(F.transform("u", lambda x, k: F.struct(x.alias("x"), F.get("u", k + 1).alias("y")))).alias("c"))
    x, y = F.col("c.x"), F.col("c.y")
    pair = F.struct(y["i"].alias("to"), F.xxhash64(x["h"], y["h"]).alias("key"))
    alone = F.struct(x["i"].alias("to"), x["h"].alias("key"))
    kinds = F.when(y.isNull(), F.when(x["many"], F.array(alone))).when(x["many"], F.array(alone, pair)).otherwise(F.array(pair))
    return near.select("a", "b", "start", x["i"].alias("at"), F.explode(kinds).alias("k")).select("a", "b", "start", "at", "k.to", "k.key")


def repeats(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``a, b, met``: the chunks ``at, to`` of each document whose key is repeated, and whether it is the ``first`` of its key."""
    rows = chunk_rows(stored(unit_hashes(docs, p), "line-dedup-hashes"))
    first = rows.groupBy("key").agg(F.min(_place(F.col("start"))).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    first = stored(first, "line-dedup-first")      # a join Spark may split, as it comes from an exchange of its own
    rows = rows.drop("start")                      # found again for the rows that are hit; it does not travel
    hit = rows.join(first.hint("shuffle_hash"), "key").select("a", "b", "at", "to", (_place(_start()) == F.col("first")).alias("first"))
    return hit.groupBy("a", "b").agg(F.collect_list(F.struct("at", "to", "first")).alias("met"))


def met_units(found: DataFrame, text: str, p: Params = Params()) -> DataFrame:
    """``a, b, at, to, x, y``: the units of each chunk in ``met`` (``y`` empty for a chunk of one)."""
    def pieces(u: Column) -> Column:
        return F.transform("met", lambda m: F.struct(m["at"].alias("at"), m["to"].alias("to"), F.get(u, m["at"]).alias("x"),
                                                     F.when(m["to"] > m["at"], F.get(u, m["to"])).otherwise("").alias("y")))
    # The whole row is bound, so that this plan and that of the result have one exchange of it in common.
    met = let(F.col("row"), lambda r: F.when(F.col("met").isNotNull(), let(F.transform(units(r[text], p), _bare), pieces)))
    return found.select("a", "b", F.explode_outer(met).alias("m")).where(F.col("m").isNotNull()).select("a", "b", "m.*")


def corrections(found: DataFrame, text: str, p: Params = Params()) -> DataFrame:
    """``a, b, judged``: the chunks whose key also belongs to other bytes, and whether each is ``gone``: a later one of equal bytes.

    Such keys are so rare that all of them are copied to every task; as long as there is none, the
    units are read once, for finding that out.
    """
    key = F.when(F.col("y") != "", F.xxhash64(_hash(F.col("x")), _hash(F.col("y")))).otherwise(_hash(F.col("x"))).alias("key")
    seen = met_units(found, text, p)
    false = seen.select("x", "y").distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    place = _place(_start())
    first = F.min(place).over(Window.partitionBy("x", "y"))
    rows = seen.select("*", key).join(F.broadcast(false), "key").select("a", "b", "at", "to", (place != first).alias("gone"))
    return rows.groupBy("a", "b").agg(F.collect_set(F.struct("at", "to", "gone")).alias("judged"))


def line_dedup(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """``docs`` without later copies of repeated runs of units, columns unchanged."""
    id, hash = _key()
    base = boxed(docs, a=id, b=hash)
    place = f"c{docs.columns.index('text')}"
    text = F.col(f"row.{place}")                                   # the box holds the text; it travels once
    found = base.join(repeats(docs, p).hint("shuffle_hash"), ["a", "b"], "left")
    found = found.join(corrections(found, place, p).hint("shuffle_hash"), ["a", "b"], "left")

    def lost(met: Column, judged: Column) -> Column:
        same = lambda m: F.get(F.filter(judged, lambda x: (x["at"] == m["at"]) & (x["to"] == m["to"])), F.lit(0))["gone"]
        gone = F.when(judged.isNull(), F.filter(met, lambda m: ~m["first"])).otherwise(F.filter(met, lambda m: F.coalesce(same(m), ~m["first"])))
        return F.array_sort(F.array_distinct(F.flatten(F.transform(gone, lambda m: F.sequence(m["at"], m["to"])))))

    def without(u: Column, g: Column) -> Column:
        part = lambda a, z: F.array_join(F.slice(u, a + 1, F.greatest(z - a, F.lit(0))), "")

        def rest(runs: Column) -> Column:
            """What stands before each run, short runs too, and what follows the last."""
            kept = F.transform(runs, lambda r, k: F.concat(
                part(F.coalesce(F.get(runs, k - 1)["z"], F.lit(0)), r["s"]),
                let(part(r["s"], r["z"]), lambda t: F.when(F.length(_bare(t)) < p.min_chars, t).otherwise(""))))
            return F.concat(F.array_join(kept, ""), part(F.get(runs, F.size(runs) - 1)["z"], F.size(u)))

        edge = lambda step: F.filter(g, lambda x, k: ~F.coalesce(F.get(g, k + step) == x + step, F.lit(False)))
        runs = let(edge(1), lambda last: F.transform(edge(-1), lambda s, k: F.struct(s.alias("s"), (F.get(last, k) + 1).alias("z"))))
        return let(runs, rest)

    again = lambda g: F.when(F.size(g) > 0, let(units(text, p), lambda u: without(u, g))).otherwise(text)
    new = F.when(F.col("met").isNotNull(), let(lost(F.col("met"), F.col("judged")), again)).otherwise(text)
    out = found.select("row", new.alias("new"))
    out = out.select("row", "new", (F.col("new") != text).alias("changed")).select(
        "row", "changed", F.when(F.col("changed"), F.regexp_replace("new", r"\n\z", "")).otherwise(F.col("new")).alias("new"))
    kind = dict(docs.dtypes)
    value = {"text": F.col("new")}
    if "n_chars" in docs.columns:
        old = F.col(f"row.c{docs.columns.index('n_chars')}")
        value["n_chars"] = F.when(F.col("changed"), F.length("new").cast(kind["n_chars"])).otherwise(old)
    return out.select(*[value.get(c, F.col(f"row.c{i}")).alias(c) for i, c in enumerate(docs.columns)])
