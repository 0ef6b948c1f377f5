"""Line dedup by a deletion-neighbourhood join, by DataFrame functions only.

A line goes if an earlier line of the corpus equals it or lies within one edit of it, judged on the input; the earliest
stays. Earlier is what has a smaller document id, then a smaller digest of the text (the first 60 bits of its MD5), then a smaller place.
Lines are compared without surrounding blanks. Copies go from ``min_copy`` code points on, variants from ``min_chars`` on;
empty and shorter lines always stay.

Equal lines become one distinct line with its first place. Two lines within one edit agree in the first
or the second half, whichever the edit isn't in. Distinct lines that share such a half with another take the other half apart
into pieces. Those that agree in all but one piece take a long piece apart again, until it is short, and then emit its
variants, itself and with one character deleted, as keys hashed with all that is outside. Equal keys meet: of lines of one
length under the place of the deletion, and of neighbouring lengths. Lines under one key differ by one character at most, so
that no key is shared by more distinct lines than a piece has places and the text has characters. The whole lines that
meet are verified by their edit distance.

Nulls and edges: a null text has no lines and stays null; rows with a null id stay as they are; rows that repeat an id
are told apart by their texts; rows that repeat both are equal and neither is earlier; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.llm.frames import few, written

#: Least code points of lines whose variants go.
MIN_CHARS = 20
#: Least code points of lines whose copies go: all that aren't blank.
MIN_COPY = 1
BLANKS = " \t\r"
#: Edits that two lines may be apart; the halves and variants are made for one.
EDITS = 1
#: Pieces into which the half with the edit is taken apart, and then each longer piece again.
PIECES, PIECE_CHARS = 8, 64
#: A row of the table: rows that repeat an id are told apart by their texts.
ROW = ("doc_id", "digest")


def lines_of(text: str | Column) -> Column:
    return F.split(text, "\n", -1)


def stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def cut(line: Column, n: Column, shorter: Column, half: int) -> tuple[Column, Column]:
    """The shared half of a line of n characters and the rest, where the edit is, if the shorter line of the pair has ``shorter`` characters."""
    first = (shorter / 2).cast("int")
    if half == 0:  # the edit is in the first half
        kept = shorter - first
        return F.substring(line, n - kept + 1, kept), F.substring(line, F.lit(1), n - kept)
    return F.substring(line, F.lit(1), first), F.substring(line, first + 1, n - first)


def half_keys(line: Column, n: Column) -> list[Column]:
    """Keys of the shared halves, as the shorter (or equal) line of a pair and as the longer one."""
    return [F.xxhash64(F.lit(half), n - longer, cut(line, n, n - longer, half)[0]) for longer in (0, 1) for half in (0, 1)]


def pieces(key: Column, rest: Column, shorter: Column, longer: Column) -> Column:
    """(key, piece) of every piece of a half that has ``shorter`` characters in the shorter line of the pair."""

    def one(j: Column) -> Column:
        begin, end = (j * shorter / PIECES).cast("int"), ((j + 1) * shorter / PIECES).cast("int")
        before, after = F.substring(rest, F.lit(1), begin), F.substring(rest, end + longer + 1, shorter - end)
        return F.struct(F.xxhash64(key, j, before, after).alias("key"), F.substring(rest, begin + 1, end + longer - begin).alias("piece"))

    return F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), one)


def variants(key: Column, piece: Column, longer: Column) -> Column:
    """(v, kind) of all variants within one edit: kind 0 for lines of one length, 1 for the shorter and 2 for the longer line of a pair."""
    n = F.char_length(piece)
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))

    def without(p: Column) -> Column:
        return F.concat(F.substring(piece, F.lit(1), p - 1), F.substring(piece, p + 1, n))

    def entry(k: Column, kind: int) -> Column:
        return F.struct(k.alias("v"), F.lit(kind).alias("kind"))

    same = F.transform(places, lambda p: entry(F.xxhash64(key, F.lit(0), p, without(p)), 0))
    longest = F.transform(places, lambda p: entry(F.xxhash64(key, F.lit(1), without(p)), 2))
    return F.when(longer, longest).otherwise(F.concat(same, F.array(entry(F.xxhash64(key, F.lit(1), piece), 1))))


def digest(text: Column) -> Column:
    """60 bits of a text's MD5."""
    return F.coalesce(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(0).cast("long"))


def alike_but_one(parts: DataFrame) -> DataFrame:
    """The pieces whose line has another that is the same outside of the piece."""
    return parts.join(parts.groupBy("key").count().where("count > 1").select("key"), "key")


def short_pieces(parts: DataFrame) -> DataFrame:
    """The pieces of lines that agree in all else, taken apart until they are short. ``parts``: row, pos, longer, key, piece."""
    found = None
    while True:
        parts = written(few(alike_but_one(parts)))  # few are left
        is_short = F.char_length("piece") <= PIECE_CHARS
        short = parts.where(is_short)
        found = short if found is None else found.unionByName(short)
        rest = parts.where(~is_short)
        if rest.isEmpty():
            return found
        again = pieces(F.col("key"), F.col("piece"), F.char_length("piece") - F.col("longer"), F.col("longer"))
        parts = rest.select(*ROW, "pos", "longer", F.explode(again).alias("p")).select(*ROW, "pos", "longer", "p.key", "p.piece")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, carry: tuple[str, ...] = (), min_copy: int = MIN_COPY) -> DataFrame:
    """One row per document: id, text (the lines that stay), n_lines, n_removed and the columns to carry along."""
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("digest"), F.col(text_col).alias("text"))
    placed = texts.select(*ROW, F.posexplode(lines_of("text")).alias("pos", "raw")).select(*ROW, "pos", stripped(F.col("raw")).alias("line"))
    compared = placed.withColumn("n", F.char_length("line")).where(F.col("n") >= min_copy)
    keys = [F.when(F.col("n") >= min_chars, k) for k in half_keys(F.col("line"), F.col("n"))]
    hashed = compared.select(*ROW, "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), *(k.alias(f"k{i}") for i, k in enumerate(keys)))
    place = F.struct(*ROW, "pos")
    firsts = hashed.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("times"), *(F.first(f"k{i}").alias(f"k{i}") for i in range(4)))
    distinct = written(few(firsts.select(*(F.when(F.col("times") > 1, F.col(h)).alias(h) for h in ("h1", "h2")), "first.*", "k0", "k1", "k2", "k3")))

    repeated = distinct.where("h1 IS NOT NULL").select("h1", "h2", place.alias("first"))
    again = hashed.select(*ROW, "pos", "h1", "h2").join(repeated, ["h1", "h2"]).where(F.col("first") < place).select(*ROW, "pos")

    halves = distinct.select(*ROW, "pos", F.posexplode(F.array("k0", "k1", "k2", "k3")).alias("which", "key")).where("key IS NOT NULL")
    met = halves.groupBy("key").count().where("count > 1").select("key")
    offered = halves.select("key", *ROW, (F.col("pos").cast("long") * 4 + F.col("which")).alias("at")).join(met, "key").groupBy(*ROW).agg(F.collect_list(F.struct("at", "key")).alias("offers"))
    every = lines_of("text")
    taken = texts.join(offered, list(ROW)).select(*ROW, "offers", every.alias("every"))
    offers = taken.select(*ROW, F.explode(F.transform("offers", lambda o: F.struct(o["at"].alias("at"), o["key"].alias("key"), stripped(F.get("every", (o["at"] / 4).cast("int"))).alias("line")))).alias("o"))
    offers = offers.select(*ROW, (F.col("o.at") / 4).cast("int").alias("pos"), (F.col("o.at") % 4).cast("int").alias("which"), "o.key", "o.line")
    longer = (F.col("which") >= 2).cast("int")
    n = F.char_length("line")
    first = ((n - longer) / 2).cast("int")
    in_first = F.col("which") % 2 == 0
    rest = F.when(in_first, cut(F.col("line"), n, n - longer, 0)[1]).otherwise(cut(F.col("line"), n, n - longer, 1)[1])
    parts = offers.select(*ROW, "pos", "key", longer.alias("longer"), F.when(in_first, first).otherwise(n - longer - first).alias("shorter"), rest.alias("rest"))
    parts = parts.select(*ROW, "pos", "longer", F.explode(pieces(F.col("key"), F.col("rest"), F.col("shorter"), F.col("longer"))).alias("p")).select(*ROW, "pos", "longer", "p.key", "p.piece")
    emitted = short_pieces(parts).select(*ROW, "pos", F.explode(variants(F.col("key"), F.col("piece"), F.col("longer") == 1)).alias("x")).select(*ROW, "pos", "x.v", "x.kind")
    under = Window.partitionBy("v")
    same = F.min(F.when(F.col("kind") != 2, place)).over(under)
    longest = F.min(F.when(F.col("kind") == 2, place)).over(under)
    pairs = emitted.select(place.alias("a"), F.when(F.col("kind") == 1, longest).otherwise(same).alias("b")).where(F.col("b") < F.col("a")).distinct()
    near = verified(written(few(pairs)), texts)

    gone = again.union(near).groupBy(*ROW).agg(F.collect_set("pos").alias("gone"))
    carried = {c: f"carried_{k}" for k, c in enumerate(carry)}
    whole = docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("digest"), F.col(text_col).alias("text"), *(F.col(c).alias(k) for c, k in carried.items()))
    with_id = whole.where("doc_id IS NOT NULL").join(gone, list(ROW), "left")  # the same shuffle of the texts as above
    left = whole.where("doc_id IS NULL").withColumn("gone", F.lit(None).cast("array<int>")).unionByName(with_id).withColumn("every", every)
    kept = F.filter("every", lambda x, i: ~F.array_contains("gone", i))
    return left.select(
        F.col("doc_id").alias(id_col), F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias(text_col),
        F.coalesce(F.size("every"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")), F.lit(0)).cast("long").alias("n_removed"),
        *(F.col(k).alias(c) for c, k in carried.items()),
    )


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The places a whose whole line is within the bound of the line at b. ``pairs``: few."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("at")).distinct().groupBy(*(F.col(f"at.{c}").alias(c) for c in ROW)).agg(F.collect_list("at.pos").alias("places"))
    fetched = texts.join(asked, list(ROW)).select(*ROW, "places", lines_of("text").alias("every")).dropDuplicates(list(ROW))
    lines = fetched.select(*ROW, F.explode("places").alias("pos"), "every").select(F.struct(*ROW, "pos").alias("at"), stripped(F.get("every", F.col("pos"))).alias("line"))
    sides = pairs.join(lines.select(F.col("at").alias("a"), F.col("line").alias("own")), "a").join(lines.select(F.col("at").alias("b"), F.col("line").alias("other")), "b")
    return sides.where(F.levenshtein("own", "other", EDITS) >= 0).select("a.*")


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All of ``documents``."""
    from rollcall.llm.frames import table

    return dedup_lines(table(spark, sf_dir, "documents"))


#: The same in DuckDB SQL, by the plain neighbourhood of whole lines.
SQL = rf"""
WITH r AS (
  SELECT row_number() OVER () AS nth, doc_id, text, coalesce(('0x' || substr(md5(text), 1, 15))::BIGINT, 0) AS digest FROM documents
), l AS (
  SELECT nth, doc_id, digest, pos, trim(raw, ' ' || chr(9) || chr(13)) AS line, raw FROM (
    SELECT nth, doc_id, digest, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM r WHERE doc_id IS NOT NULL)
), d AS (
  SELECT line, min((doc_id, digest, pos)) AS first FROM l WHERE length(line) >= {MIN_COPY} GROUP BY line
), long AS (SELECT * FROM d WHERE length(line) >= {MIN_CHARS}
), v AS (
  SELECT line, first, line AS variant FROM long UNION ALL
  SELECT line, first, substr(line, 1, p - 1) || substr(line, p + 1) FROM (SELECT line, first, unnest(range(1, length(line) + 1)) AS p FROM long)
), h AS (
  SELECT DISTINCT line, first, hash(variant) AS k FROM v
), near AS (
  SELECT DISTINCT a.line FROM h a JOIN h b ON a.k = b.k WHERE b.first < a.first AND a.line <> b.line AND levenshtein(a.line, b.line) <= {EDITS}
), judged AS (
  SELECT l.nth, l.pos, l.raw, coalesce(d.first < (l.doc_id, l.digest, l.pos) OR near.line IS NOT NULL, false) AS gone FROM l LEFT JOIN d ON l.line = d.line LEFT JOIN near ON l.line = near.line
)
SELECT r.doc_id, CASE WHEN r.doc_id IS NULL THEN r.text WHEN r.text IS NULL THEN NULL ELSE coalesce(kept, '') END AS text, coalesce(n_lines, len(string_split(r.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed
FROM r LEFT JOIN (
  SELECT nth, string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS kept, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed FROM judged GROUP BY nth
) USING (nth)
"""
