"""Fuzzy line deduplication by MinHash, in DataFrame functions only."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import components, own_name, settle

#: Lines are alike from this Jaccard similarity of their sets of all ``SHINGLE`` characters in a row.
SIMILARITY = 0.8
SHINGLE = 5
#: Signatures: ``BANDS`` bands of ``BAND_ROWS`` minima over anchored shingles of ``ANCHORED`` characters.
BANDS = 8
BAND_ROWS = 4
ANCHORED = 7
#: Characters a blank from which on lines are anchored at every character; up to twice as many at words too.
SPARSE = 16
#: Plan only, results agree: up to so many candidate lines (a long each), or numbers of lines to drop, are broadcast;
#: more are joined by shuffle.
BROADCAST_LINES = 2_000_000
#: Plan only, results agree: up to so many odd lines meet all lines of their bucket; more are dealt by rare shingles first.
FEW_ODD = 256
#: Plan only, results agree: from so many pairs a candidate line on, one in ``AHEAD`` is met and verified ahead of the others.
#: Pairs are told from the sizes of buckets: on the check tables one meeting in ``MEETINGS`` passes the filters.
MANY_PAIRS = 4
MEETINGS = 12
AHEAD = 8
#: Plan only, results agree: up to so many characters a line's shingles are taken in one pass, as strings first.
ONE_PASS = 65_536
#: Longs of parity bits a line, a power of two, and what sums of fractions may be off by.
PARITIES = 8
SLACK = 1e-6

WHITE = " \t\n\x0b\x0c\r"


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``doc`` (hash of the text), ``line_no``, ``line`` and ``h`` of every line that has a word."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    split = rows.select("id", F.xxhash64("text").alias("doc"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return split.where(F.btrim("line", F.lit(WHITE)) != "").withColumn("h", F.xxhash64("line"))


def _signatures(lines: DataFrame) -> DataFrame:
    """``h``, ``kind`` and the minima of each distinct line's anchored shingles under ``BANDS * BAND_ROWS`` orders.

    A shingle takes the characters from its anchor on, blanks left out.
    Anchors are the starts of words (kind 0), or all characters where blanks
    are sparse (kind 1): a content-defined choice, so equal stretches of two
    lines give equal shingles. Lines between ``SPARSE`` and twice as many
    characters a blank have signatures of both kinds, so a few blanks more or
    less part no two lines. Masks of a 32-bit hash give the orders.
    """
    blanks = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit("")))
    words = F.when(F.length("line") <= 2 * SPARSE * (blanks + 1), F.split("line", " "))
    letters = F.when(F.length("line") > SPARSE * (blanks + 1), F.split(F.replace("line", F.lit(" "), F.lit("")), ""))
    kinds = lines.select("h", F.posexplode(F.array(words, letters)).alias("kind", "units")).where("units IS NOT NULL")
    placed = kinds.select("h", "kind", "units", F.explode(F.sequence(F.lit(0), F.size("units") - 1)).alias("i"))
    run = F.concat_ws("", *[F.get("units", F.col("i") + j) for j in range(ANCHORED)])
    hashed = placed.where(F.get("units", "i") != "").select("h", "kind", F.hash(F.substring(run, 1, ANCHORED)).alias("s"))
    masks = random.Random(20_011)
    minima = [
        F.min(F.col("s").bitwiseXOR(F.lit(masks.getrandbits(31)))).alias(f"m{k}") for k in range(BANDS * BAND_ROWS)
    ]
    return hashed.groupBy("h", "kind").agg(*minima)


def _bands(signatures: DataFrame) -> DataFrame:
    """``h`` and the keys of its bands, which tell the bands and kinds apart too."""
    number = [F.lit(b) + BANDS * F.col("kind") for b in range(BANDS)]
    keys = [F.xxhash64(number[b], *[f"m{b * BAND_ROWS + r}" for r in range(BAND_ROWS)]) for b in range(BANDS)]
    return signatures.select("h", F.array(*keys).alias("bands"))


def _star(rows: DataFrame) -> DataFrame:
    """``band``, ``rep``, ``h``: each line of a bucket against the bucket's representative, its smallest line."""
    least = F.min("h").over(Window.partitionBy("band"))
    return rows.select("band", least.alias("rep"), "h").where("rep <> h")


def _candidates(bands: DataFrame) -> DataFrame:
    return _star(bands.select("h", F.explode("bands").alias("band")))


def _pieces(text: Column, size: int) -> Column:
    """Pieces that begin every ``size`` characters and overlap by a shingle less one character."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - SHINGLE + 1, F.lit(1)), F.lit(size))
    return F.transform(starts, lambda p: F.substring(text, p, F.lit(size + SHINGLE - 1)))


def _shingles(line: Column) -> Column:
    """Hashes (64 bits) of all shingles of a line, each once.

    One pattern gives all shingles of a line in one pass. Its places are
    UTF-16 units, so lines with characters beyond these are walked, and so
    are short lines, whose one shingle is the line, and very long ones. A
    character is found by walking from the start, so such a line is cut into
    pieces, and those again, before shingles are taken.
    """

    def within(part: Column) -> Column:
        last = F.greatest(F.length(part) - SHINGLE + 1, F.lit(1))
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.substring(part, i, F.lit(SHINGLE))))

    small = F.flatten(F.transform(_pieces(line, 4096), lambda part: _pieces(part, 32)))
    walked = F.flatten(F.transform(small, within))
    passed = F.transform(F.regexp_extract_all(line, F.lit(f"(?s)(?=(.{{{SHINGLE}}}))"), F.lit(1)), lambda s: F.xxhash64(s))
    plain = F.length(line).between(SHINGLE, ONE_PASS) & ~line.rlike("[\\x{10000}-\\x{10FFFF}]")
    return F.array_distinct(F.when(plain, passed).otherwise(walked))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``a``, ``b`` whose lines have at least the asked Jaccard similarity."""
    left = texts.select(F.col("h").alias("a"), F.col("line").alias("line_a"))
    right = texts.select(F.col("h").alias("b"), F.col("line").alias("line_b"))
    met = pairs.join(left, "a").join(right, "b")
    # A filter over computed columns would compute both sets again for each mention; bound like this they are made once.
    sets = F.array(F.struct(_shingles(F.col("line_a")).alias("x"), _shingles(F.col("line_b")).alias("y")))
    sizes = F.transform(sets, lambda s: F.struct(F.size(F.array_intersect(s.x, s.y)).alias("n"), (F.size(s.x) + F.size(s.y)).alias("all")))
    return met.where(F.exists(sizes, lambda s: s.n >= SIMILARITY * (s.all - s.n))).select("a", "b")


def _texts(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """One text per wanted ``h``."""
    small = wanted.count() <= BROADCAST_LINES
    return lines.select("h", "line").join(F.broadcast(wanted) if small else wanted, "h").dropDuplicates(["h"])


def _mixed(star: DataFrame, rest: DataFrame, roots: DataFrame) -> DataFrame:
    """``band``, ``h``, ``root``, ``odd`` and ``n_odd`` of all lines of buckets that hold several components.

    Odd lines are those outside the bucket's largest component.
    """
    mixed = star.join(rest.select("band").distinct(), "band")
    members = mixed.select("band", "h").union(mixed.select("band", F.col("rep").alias("h"))).distinct()
    placed = members.join(roots.select(F.col("a").alias("h"), F.col("b").alias("root")), "h", "left")
    placed = settle(placed.select("band", "h", F.coalesce("root", "h").alias("root")), "lines-placed")
    groups = placed.groupBy("band", "root").agg(F.count("*").alias("n"))
    main = groups.groupBy("band").agg(F.max(F.struct("n", "root")).alias("main"), (F.sum("n") - F.max("n")).alias("n_odd"))
    odd = (F.col("root") != F.col("main.root")).alias("odd")
    return placed.join(main.where("n_odd > 0"), "band").select("band", "h", "root", odd, "n_odd")


def _measures(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``h``, the number ``n`` of a line's shingles, and the parities ``p0``... of their numbers by 512 hash values.

    Two parities differ only where a shingle is in one line and not in the
    other, so lines have at least as many shingles apart as parities.
    """
    rows = texts.join(wanted, "h").select("h", F.explode(_shingles(F.col("line"))).alias("s"))
    bit = F.expr("shiftleft(1L, CAST(s & 63 AS INT))")
    word = F.expr(f"shiftrightunsigned(s, 6) & {PARITIES - 1}")
    parities = [F.bit_xor(F.when(word == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"p{k}") for k in range(PARITIES)]
    return rows.groupBy("h").agg(F.count("*").alias("n"), *parities)


def _met(left: DataFrame, right: DataFrame, on: list[str], *more: Column) -> DataFrame:
    """Pairs ``a`` < ``b`` of other components with equal ``on``, and ``more``, that may be alike by size and parities."""
    x, y = left.alias("x"), right.alias("y")
    both = F.col("x.n") + F.col("y.n")
    apart = sum((F.bit_count(F.col(f"x.p{k}").bitwiseXOR(F.col(f"y.p{k}"))) for k in range(PARITIES)), F.lit(0))
    fits = F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * SIMILARITY - SLACK
    fits &= apart <= both * (1 - SIMILARITY) / (1 + SIMILARITY) + SLACK
    keys = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in on]
    met = x.join(y, [*keys, F.col("x.root") != F.col("y.root"), *more, fits])
    return met.select(F.least("x.h", "y.h").alias("a"), F.greatest("x.h", "y.h").alias("b"))


def _prefixes(measured: DataFrame, texts: DataFrame) -> DataFrame:
    """A row of each line for each shingle ``s`` of its prefix, its rarest ones, with the line's ``bands`` of ``measured``.

    Of two lines of ``n`` shingles or fewer that are alike, the longer one's
    rarest floor(0.2 n) + 1 and the shorter one's rarest floor(n / 9) + 1
    (``short``) share one, as both are in the same order. Shingles that no
    other line has meet nobody and are left out. The order is one for all
    buckets, so a line's shingles are made and ranked once, not in each bucket.
    """
    own = ["h", "root", "n", *[f"p{k}" for k in range(PARITIES)]]
    members = settle(measured.groupBy(*own).agg(F.collect_set("band").alias("bands")), "lines-members")
    cut = texts.join(members.select("h", "n"), "h").select("h", "n", F.explode(_shingles(F.col("line"))).alias("s"))
    counted = cut.withColumn("f", F.count("*").over(Window.partitionBy("s")))
    ranked = counted.withColumn("place", F.row_number().over(Window.partitionBy("h").orderBy("f", "s"))).where("f > 1")
    longest = F.floor(F.col("n") * (1 - SIMILARITY) + SLACK) + 1
    short = F.col("place") <= F.floor(F.col("n") * (1 - SIMILARITY) / (1 + SIMILARITY) + SLACK) + 1
    return ranked.where(F.col("place") <= longest).select("h", "s", short.alias("short")).join(members, "h")


def _meeting(members: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame | None, float]:
    """Lines of mixed buckets as they meet: by bucket where its odd lines are few, else by shingles of their prefixes.

    The number is that of all pairs of buckets with an odd line, before any filter.
    """
    own = members.groupBy("h").agg(F.collect_set("band").alias("bands"))
    measured = settle(members.join(_measures(texts, own.select("h")), "h").join(own, "h"), "lines-mixed")
    few, many = measured.where(F.col("n_odd") <= FEW_ODD), measured.where(F.col("n_odd") > FEW_ODD)
    meetings = measured.agg(F.sum(F.when(F.col("odd"), (F.col("n_odd") - 1) / 2).otherwise(F.col("n_odd")))).first()[0] or 0
    return few, None if many.isEmpty() else settle(_prefixes(many, texts), "lines-prefixes"), meetings


def _pairs(few: DataFrame, keyed: DataFrame | None, *more: Column) -> DataFrame:
    """Pairs ``a``, ``b`` that meet by bucket or by shingle, each once.

    Odd lines meet every line of a bucket: of two lines of other components at least one is odd. A pair is met in the
    least of its common ``bands`` only, whichever of its lines is odd there.
    """
    least = F.col("x.band") == F.array_min(F.array_intersect("x.bands", "y.bands"))
    once = (F.col("x.h") < F.col("y.h")) | ~F.col("y.odd")
    pairs = _met(few.where("odd"), few, ["band"], once, *more, least)
    if keyed is not None:
        shorter = F.expr("(x.n <= y.n AND x.short) OR (y.n <= x.n AND y.short)")
        pairs = pairs.union(_met(keyed, keyed, ["s"], F.col("x.h") < F.col("y.h"), shorter, *more, F.arrays_overlap("x.bands", "y.bands")))
    return pairs.distinct()


def _rest_pairs(members: DataFrame, texts: DataFrame) -> DataFrame:
    """All pairs ``a``, ``b`` of mixed buckets that may be alike and are not known to be of one component.

    Odd lines meet every line of their bucket, or, where they are many, every
    line that shares a shingle of both prefixes. What is left out is not alike.
    """
    few, keyed, _ = _meeting(members, texts)
    return _pairs(few, keyed)


def _links(lines: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` between the hashes of different lines, with the components of all verified pairs.

    In each bucket all lines are compared with its representative. Where that
    leaves several components in a bucket, its odd lines are compared with
    every other line of their bucket, so that no link inside a bucket is missed.
    Where these pairs may be many, a part of them is met and verified first,
    and of the others those that it leaves in different components.
    """
    star = settle(_candidates(_bands(_signatures(lines))), "lines-star")
    wanted = settle(star.select("h").union(star.select("rep")).distinct(), "lines-wanted")
    texts = settle(_texts(lines, wanted), "lines-texts")
    first = star.select(F.col("rep").alias("a"), F.col("h").alias("b")).distinct()
    alike = settle(_verified(first, texts), "lines-alike")
    done = alike.select(F.col("a").alias("rep"), F.col("b").alias("h"))
    rest = settle(star.join(done, ["rep", "h"], "left_anti"), "lines-rest")
    if rest.isEmpty():
        return alike
    known = components(alike, "lines").where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    known = settle(known, "lines-known")
    mixed = _mixed(star, rest, known)
    few, keyed, meetings = _meeting(mixed, texts)

    def linked(*more: Column) -> DataFrame:
        pairs = settle(_pairs(few, keyed, *more).join(first, ["a", "b"], "left_anti"), "lines-second")
        return settle(known.union(_verified(pairs, texts)), "lines-alike")

    if meetings < MEETINGS * MANY_PAIRS * wanted.count():
        return linked()
    ahead = F.pmod(F.xxhash64(F.least("x.h", "y.h"), F.greatest("x.h", "y.h")), F.lit(AHEAD)) == 0
    known = linked(ahead)
    roots = settle(components(known, "lines"), "lines-roots")
    few, keyed = _renewed(few, roots), None if keyed is None else _renewed(keyed, roots)
    return linked(~ahead)


def _renewed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``members`` with the ``root`` that later links give their lines; lines without links keep themselves."""
    of = roots.select(F.col("node").alias("h"), F.col("root").alias("later"))
    met = members.join(of, "h", "left").withColumn("root", F.coalesce("later", "h")).drop("later")
    return settle(met, "lines-renewed")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``doc`` and ``gone``: numbers (from 0) of the lines that repeat an earlier one, per document."""
    lines = _lines(docs, id_col, text_col)
    places = settle(lines.select("id", "doc", "line_no", "h", F.hash("line").alias("g")), "lines-places")
    roots = settle(components(_links(lines), "lines").withColumnRenamed("node", "h"), "lines-roots")
    twice = places.groupBy("h", "g").agg(F.count("*").alias("n")).where("n > 1").select("h").distinct()
    affected = twice.join(roots, "h", "full").select("h", F.coalesce("root", "h").alias("root"), F.col("root").isNotNull().alias("fuzzy"))
    rows = places.join(affected, "h").select(
        "id", "doc", "line_no", "root", F.when(F.col("fuzzy"), F.lit(0)).otherwise(F.col("g")).alias("g")
    )
    rows = settle(rows, "lines-rows")
    place = F.struct(F.col("id").isNull().alias("late"), "id", "doc", "line_no")
    kept = rows.groupBy("root", "g").agg(F.min(place).alias("kept"))
    gone = rows.join(kept, ["root", "g"]).where(place != F.col("kept"))
    return gone.groupBy("id", "doc").agg(F.collect_set("line_no").alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated lines taken out of ``text_col``, and ``n_lines`` and ``n_removed`` (long) behind.

    Lines are the parts between line ends that hold a word; each component of
    equal or alike lines keeps its first line, by id (nulls last), text hash
    and place. Blank lines stay. A document whose lines all go keeps an empty
    text or its blank lines; a null text stays null with no lines. Rows of
    equal id and text are one document given twice and are cut alike. An
    empty table gives no rows. Counts whose names the table has already get
    underscores behind. Texts move once to meet the list of lines to drop,
    or not at all where that is short.
    """
    gone = repeated_lines(docs, id_col, text_col)
    names = {n: own_name(docs.columns, n) for n in ("lines_doc", "lines_id", "lines_key", "lines_gone", "lines_split", "n_lines", "n_removed")}
    gone = gone.select(
        F.col("id").alias(names["lines_id"]), F.col("doc").alias(names["lines_key"]), F.col("gone").alias(names["lines_gone"])
    )
    keyed = docs.withColumn(names["lines_doc"], F.xxhash64(text_col))
    gone = settle(gone, "lines-gone")
    listed = gone.agg(F.coalesce(F.sum(1 + F.size(names["lines_gone"])), F.lit(0))).first()[0]
    met = keyed.join(
        F.broadcast(gone) if listed <= BROADCAST_LINES else gone,
        keyed[id_col].eqNullSafe(gone[names["lines_id"]]) & (keyed[names["lines_doc"]] == gone[names["lines_key"]]),
        "left",
    )
    # A column of its own: inside the functions over its elements the text would be split again for each.
    met = met.withColumn(names["lines_split"], F.split(text_col, "\n"))
    split = F.col(names["lines_split"])
    all_ = F.sequence(F.lit(0), F.size(split) - 1)
    kept = F.transform(F.array_except(all_, names["lines_gone"]), lambda i: F.get(split, i))
    text = F.when(F.col(names["lines_gone"]).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    with_word = F.size(F.filter(split, lambda line: F.btrim(line, F.lit(WHITE)) != ""))
    return met.select(
        *[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns],
        F.coalesce(F.when(F.col(text_col).isNotNull(), with_word), F.lit(0)).cast("long").alias(names["n_lines"]),
        F.coalesce(F.when(F.col(names["lines_gone"]).isNotNull(), F.size(names["lines_gone"])), F.lit(0))
        .cast("long")
        .alias(names["n_removed"]),
    )
