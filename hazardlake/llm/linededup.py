"""Line dedup: passages of ``min_words`` words or more that repeat anywhere in the corpus are removed.

Native DataFrame expressions throughout.

* A text is split at every white space character.  Of any ``WINDOW`` neighbouring
  words the one with the smallest hash (the first of equal ones) is an anchor,
  in whatever script; the words from an anchor on, ``min_words - WINDOW + 1`` of
  them, are hashed in order.  Anchors depend on the words of their window only,
  so equal passages have equal anchors wherever they stand, and each passage
  of ``min_words`` words has an anchor whose hashed words lie inside it.
* The windows of a text are exploded into rows, so that compiled code and no
  interpreted function of an array finds the anchors (``anchors``).
* In a text that repeats a few words over and over neighbouring anchors have equal
  hashes; it is looked at as a whole (``chunk_array``): they become one row, or two, so that the first ``min_words`` words
  are the passage that the rest repeats.
* Whole copies of a text are found by digest and need no anchors.
* Hashes are counted over all other documents (combined before the shuffle).
  The first occurrence, in order of (doc_id, text hash, position), stays.
* Every other occurrence is compared word by word with the first one and the
  match is followed to both sides (``min_words`` words; a longer match has more
  anchors).  Matches of ``min_words`` words or more are cut out, joined where they
  touch.
* Occurrences that share fewer words with the first place are held against each
  other: all passages of ``min_words`` words around them are grouped by their
  bytes, and of each group the first stays.

So of every passage of ``min_words`` words that stands at several places only the
first stays whole.  White space characters count alike.  What is removed stood,
byte by byte, at a place before, by the order above (of passages that overlap
there, each at its own).  NULL texts stay NULL, empty ones empty.
Rows with the same id and text are one document and are treated alike.  Other
columns, whatever their names, pass through; the added ones replace columns of
the same name.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hazardlake.llm.common import let, materialise

SPACE = r"[ \t-\r]"           # one byte, taken off
MIN_WORDS = 50
WINDOW = 16                  # neighbouring words of which one at least is an anchor
PLACE_BITS = 28              # of an anchor's place in a text, below its hash
BLOCK = 16                   # elements of a block of prefix sums
BROADCAST_ROWS = 200_000     # keys or edits of documents; beyond it they are joined by shuffling
BROADCAST_HASHES = 3_000_000  # repeated hashes, 24 MB; the same


def words(text: Column) -> Column:
    """The words of a text, with empty ones between neighbouring white space characters."""
    return F.split(text, SPACE)


def offsets(sizes: Column) -> Column:
    """Sums of the elements before each element, in blocks so that long arrays are not copied for each."""
    def append(acc, x):
        return F.concat(acc, F.array(F.element_at(acc, -1) + x))

    def part(b):
        return F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK))

    def inside(starts):
        return F.flatten(F.transform(starts, lambda s, b: let(
            F.aggregate(part(b), F.array(s), append), lambda sums: F.slice(sums, 1, F.size(sums) - 1))))

    totals = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int")),
                         lambda b: F.aggregate(part(b), F.lit(0), lambda x, y: x + y))
    return let(F.aggregate(totals, F.array(F.lit(0)), append), lambda t: inside(F.slice(t, 1, F.size(t) - 1)))


def hashed_words(window: int, min_words: int) -> int:
    """So many words from an anchor on that a passage of ``min_words`` words holds those of one anchor."""
    return max(min_words - window + 1, 1)


def chunk_array(text: Column, window: int = WINDOW, min_words: int = MIN_WORDS) -> Column:
    """Array of (hash, at, last, gap): the hashed words of the anchor ``at``, and of all anchors up to ``last`` in steps of ``gap``."""
    size = hashed_words(window, min_words)
    low = (1 << PLACE_BITS) - 1

    def least(keys, reach):
        """The smallest key of each ``window`` neighbours; a pass looks at four at a time."""
        if reach >= window:
            return keys
        steps = [i * reach for i in range(1, 4) if i * reach < window]
        steps[-1] = min(steps[-1], window - reach)
        grown = steps[-1] + reach
        return let(F.transform(keys, lambda x, i: F.least(x, *[F.get(keys, i + k) for k in steps])), lambda k: least(k, grown))

    def of_anchors(hashed, places):
        hashes = F.transform(places, lambda i: F.xxhash64(F.slice(hashed, i + 1, F.lit(size))))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.transform(h, lambda x, j: F.struct(
            x.alias("hash"), F.get(places, j).alias("at"), F.get(places, j).alias("last"), F.lit(0).alias("gap"))))
            .otherwise(of_equal(h, places)))

    def of_equal(h, places):
        """Neighbouring anchors with equal hashes become one row, or two."""
        return let(F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda j: (j == 0) | (F.get(h, j) != F.get(h, j - 1))),
                   lambda starts: F.flatten(F.transform(starts, lambda j, k: rows(h, places, j, F.coalesce(F.get(starts, k + 1), F.size(h)) - 1))))

    def rows(h, places, j, end):
        def row(a, b, gap):
            return F.struct(F.get(h, j).alias("hash"), F.get(places, a).alias("at"), F.get(places, b).alias("last"), gap.alias("gap"))

        def split(gap):
            own = j + F.ceil(F.lit(min_words) / gap).cast("int")            # the anchor that is min_words words on
            return F.when(own <= end, F.array(row(j, own - 1, gap), row(own, end, gap))).otherwise(F.array(row(j, end, gap)))

        return F.when(j == end, F.array(row(j, j, F.lit(0)))).otherwise(let(F.get(places, j + 1) - F.get(places, j), split))

    def of_words(w):
        return F.when(F.size(w) >= min_words, let(F.transform(w, lambda x: F.xxhash64(x)), of_hashes))

    def of_hashes(hashed):
        keys = F.transform(hashed, lambda x, i: x.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))
        picked = let(keys, lambda k: F.array_distinct(F.slice(least(k, 1), F.lit(1), F.size(hashed) - (min_words - 1))))
        return let(F.transform(picked, lambda k: k.bitwiseAND(F.lit(low)).cast("int")), lambda places: of_anchors(hashed, places))

    return let(words(text), of_words)


def anchors(texts: DataFrame, window: int = WINDOW, min_words: int = MIN_WORDS) -> DataFrame:
    """(hash, id, h, at, again): the anchors of ``texts`` (id, h, text), one row each.

    ``again``: the anchor before has the same hash; rows of such texts are to be taken from ``chunk_array``.  All others
    are the same there.  The words of a text are hashed in one loop; its windows are rows, which compiled expressions look at.
    A window names an anchor if the one before does not: the word that left was the smallest, or the one that came is.
    """
    size, i = hashed_words(window, min_words), F.col("i")

    def passage(at):
        return F.xxhash64(F.slice("hashed", at + 1, F.lit(size)))

    hashed = texts.select("id", "h", F.transform(words(F.col("text")), lambda x: F.xxhash64(x)).alias("hashed"))
    starts = F.when(F.size("hashed") >= min_words, F.sequence(F.lit(0), F.size("hashed") - min_words))
    inner = F.slice("hashed", i + 1, F.lit(window - 1))              # what the window shares with the one before
    least, left, came = F.array_min(inner), F.get("hashed", i - 1), F.get("hashed", i + (window - 1))
    named = (hashed.select("id", "h", "hashed", F.explode(starts).alias("i"))
             .where((i == 0) | (F.least(left, came) <= least))      # most windows end here, with one search
             .where((i == 0) | (left <= least) | (came < least))
             .select("id", "h", "hashed", "i", (i + F.array_position(inner, least) - 1).cast("int").alias("inside"),
                     (came < least).alias("comes"), (left <= least).alias("leaves")))
    places = named.select("id", "h", "hashed", F.when(F.col("comes"), i + (window - 1)).otherwise(F.col("inside")).alias("at"),
                          F.when(F.col("leaves"), i - 1).when(i > 0, F.col("inside")).alias("before"))
    found = places.select("id", "h", "hashed", "at", "before", passage(F.col("at")).alias("hash"))
    again = F.when(F.get("hashed", F.col("at")) == F.get("hashed", F.col("before")), F.col("hash") == passage(F.col("before"))).otherwise(False)
    return found.select("hash", "id", "h", "at", again.alias("again"))


def chained(found: Column, size: int) -> Column:
    """(at, last, gap, f_at) of matches; those of neighbouring anchors that overlap alike in both texts are one."""
    def follows(i):
        x, before = F.get(found, i), F.get(found, i - 1)
        return ((x["at"] - before["at"] == x["f_at"] - before["f_at"]) & (x["at"] <= before["at"] + size)
                & (x["gap"] == 0) & (before["gap"] == 0))

    def joined(starts):
        return F.transform(starts, lambda i, k: let(F.get(found, F.coalesce(F.get(starts, k + 1), F.size(found)) - 1), lambda end: F.struct(
            F.get(found, i)["at"].alias("at"), end["last"].alias("last"), end["gap"].alias("gap"), F.get(found, i)["f_at"].alias("f_at"))))

    return let(F.filter(F.sequence(F.lit(0), F.size(found) - 1), lambda i: (i == 0) | ~follows(i)), joined)


def _common(a: Column, b: Column) -> Column:
    """Number of leading elements that two arrays share."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    return let(F.struct(F.array_position(same, F.lit(False)).cast("int").alias("p"), F.size(same).alias("n")),
               lambda r: F.when(r["p"] == 0, r["n"]).otherwise(r["p"] - 1))


def matches(own: Column, other: Column, found: Column, same: Column, size: int, min_words: int) -> Column:
    """Intervals of words that equal their first occurrence, followed to both sides; ``same``: both texts are one.

    Within one text an interval starts where it repeats words that stand ``min_words`` or more before it.
    """
    def piece(w, at, n):
        return F.slice(w, at + 1, F.greatest(n, F.lit(0)))

    def interval(x):
        n = x["last"] - x["at"] + size
        equal = F.when(x["gap"] == 0, piece(own, x["at"], n) == piece(other, x["f_at"], n)).otherwise(
            (piece(own, x["at"], F.lit(size)) == piece(other, x["f_at"], F.lit(size)))
            & (piece(own, x["at"], n - x["gap"]) == piece(own, x["at"] + x["gap"], n - x["gap"])))
        end, f_end = x["at"] + n, x["f_at"] + F.when(x["gap"] == 0, n).otherwise(F.lit(size))
        near = F.least(x["at"], x["f_at"], F.lit(min_words))
        far = F.least(F.size(own) - end, F.size(other) - f_end, F.lit(min_words))
        back = _common(F.reverse(piece(own, x["at"] - near, near)), F.reverse(piece(other, x["f_at"] - near, near)))
        ahead = _common(piece(own, end, far), piece(other, f_end, far))
        shift = x["at"] - x["f_at"]

        def moved(s):
            return F.when(same & (shift < min_words), s - shift + F.ceil(F.lit(min_words) / shift).cast("int") * shift).otherwise(s)

        return F.when(equal, F.struct(moved(x["at"] - back).alias("s"), (end + ahead).alias("e")))

    least = F.when(same, F.lit(1)).otherwise(F.lit(min_words))     # parts of two places do not add up to a passage
    return F.filter(F.transform(chained(found, size), interval), lambda i: i["e"] - i["s"] >= least)


def around(w: Column, at: Column, size: int, min_words: int) -> Column:
    """(s, bytes): all passages of ``min_words`` words that hold the ``size`` words from ``at`` on, by the SHA-256 of their words."""
    first, last = F.greatest(at - (min_words - size), F.lit(0)), F.least(at, F.size(w) - min_words)
    return F.when(first <= last, F.transform(F.sequence(first, last), lambda s: F.struct(
        s.cast("int").alias("s"), F.sha2(F.array_join(F.slice(w, s + 1, F.lit(min_words)), " "), 256).alias("bytes"))))


def runs(intervals: Column) -> Column:
    """Sorted intervals joined where they touch."""
    kind = "array<struct<s:int,e:int>>"

    def add(acc, x):
        return let(F.get(acc, F.size(acc) - 1), lambda last: F.when(
            x["s"] <= last["e"],
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        ).otherwise(F.concat(acc, F.array(F.struct(x["s"].alias("s"), x["e"].alias("e"))))))

    return F.aggregate(F.array_sort(intervals), F.array().cast(kind), add)


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), lambda w: w != ""))


def _cut(raw: Column, cuts: Column) -> Column:
    """The bytes outside the cuts."""
    def before(r, k):
        start = F.coalesce(F.get(cuts, k - 1)["e"], F.lit(0))
        return F.substring(raw, start + 1, r["s"] - start).cast("string")

    rest = let(F.get(cuts, F.size(cuts) - 1)["e"], lambda e: F.substring(raw, e + 1, F.octet_length(raw)).cast("string"))
    return F.concat(F.array_join(F.transform(cuts, before), ""), rest)


def byte_spans(w: Column, cuts: Column, n_bytes: Column) -> Column:
    """(s, e, n): bytes and number of words of intervals of words; a word takes the white space after it along."""
    def size(start, end):
        return F.when(end > start, F.octet_length(F.array_join(F.slice(w, start + 1, end - start), " ")) + 1).otherwise(0)

    def pieces(r, k):
        return F.array(size(F.coalesce(F.get(cuts, k - 1)["e"], F.lit(0)), r["s"]), size(r["s"], r["e"]))

    def spans(sizes, at):
        return F.transform(cuts, lambda r, k: F.struct(
            F.get(at, 2 * k + 1).alias("s"), F.least(F.get(at, 2 * k + 1) + F.get(sizes, 2 * k + 1), n_bytes).alias("e"),
            F.size(F.filter(F.slice(w, r["s"] + 1, r["e"] - r["s"]), lambda x: x != "")).alias("n")))

    return let(F.flatten(F.transform(cuts, pieces)), lambda z: let(offsets(z), lambda at: spans(z, at)))


def anchor_rows(firsts: DataFrame, window: int, min_words: int, beside) -> DataFrame:
    """(hash, id, h, at, last, gap) of all texts; those that repeat a few words over and over are few and meet ``chunk_array``."""
    def arrays(texts):
        return (texts.select("id", "h", F.explode(chunk_array(F.col("text"), window, min_words)).alias("c"))
                .select("c.hash", "id", "h", "c.at", "c.last", "c.gap"))

    if window < 2:
        return materialise(arrays(firsts), "chunks")
    found = materialise(anchors(firsts, window, min_words), "anchors")
    odd = materialise(found.where("again").select(F.col("id").alias("r_id"), F.col("h").alias("r_h")).distinct(), "repeating")
    of_odd = F.col("id").eqNullSafe(F.col("r_id")) & (F.col("h") == F.col("r_h"))
    plain = beside(found, odd, of_odd, "left_anti").select("hash", "id", "h", "at", F.col("at").alias("last"), F.lit(0).alias("gap"))
    return plain.union(materialise(arrays(beside(firsts, odd, of_odd, "left_semi")), "chunks"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                window: int = WINDOW) -> DataFrame:
    """``df`` with repeated passages cut from the text, plus ``removed_spans`` (byte spans of the original
    text in UTF-8) and ``removed_words``.
    """
    window = min(window, max(min_words // 2, 1))
    size = hashed_words(window, min_words)
    keyed = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text")).where("text <> ''")

    def beside(left, right, on, how, limit=BROADCAST_ROWS):
        """A join whose right side is broadcast while it is small."""
        return left.join(F.broadcast(right) if right.count() <= limit else right, on, how)

    # 1. whole copies of a text (equal SHA-256 and length) need no anchors
    digests = materialise(keyed.select("id", "h", F.sha2("text", 256).alias("d"), F.octet_length("text").alias("size")), "digests")
    same = digests.groupBy("d", "size").agg(F.min("id").alias("f_id"), F.count("*").alias("n")).where("n > 1")
    copies = materialise(digests.join(same, ["d", "size"]).where(~F.col("id").eqNullSafe(F.col("f_id"))).select(
        F.col("id").alias("c_id"), F.col("h").alias("c_h"), "size").distinct(), "copies")
    firsts = beside(keyed, copies, F.col("id").eqNullSafe(F.col("c_id")) & (F.col("h") == F.col("c_h")), "left_anti")

    # 2. anchors, and those whose hash occurs more than once
    place = ["id", "h", "at", "last", "gap"]
    chunks = anchor_rows(firsts, window, min_words, beside)
    often = materialise(chunks.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "often")
    again = materialise(beside(chunks, often, "hash", "left_semi", BROADCAST_HASHES), "repeated")

    # 3. all but the first occurrence, by document and document of the first
    first = again.groupBy("hash").agg(F.min(F.struct("id", "h", "at")).alias("f")).select("hash", *[F.col(f"f.{c}").alias(f"f_{c}") for c in ("id", "h", "at")])
    later = again.join(first, "hash").where(~(F.col("id").eqNullSafe(F.col("f_id")) & (F.col("h") == F.col("f_h")) & (F.col("at") == F.col("f_at"))))
    pairs = materialise(later.groupBy("id", "h", "f_id", "f_h").agg(
        F.sort_array(F.collect_set(F.struct(*place[2:], "f_at"))).alias("found")), "pairs")

    # 4. texts of these documents, once each; comparison
    wanted = materialise(pairs.select("id", "h").union(pairs.select("f_id", "f_h")).distinct().select(
        F.col("id").alias("w_id"), F.col("h").alias("w_h")), "wanted")
    texts = materialise(beside(keyed, wanted, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("h") == F.col("w_h")), "left_semi",
                               5 * BROADCAST_ROWS), "texts")
    if texts.count() > wanted.count():            # some rows repeat an id and its text
        texts = texts.dropDuplicates(["id", "h"])
    own = texts.select(F.col("id").alias("t_id"), F.col("h").alias("t_h"), F.col("text").alias("own"))
    other = texts.select(F.col("id").alias("o_id"), F.col("h").alias("o_h"), F.col("text").alias("other"))
    both = (pairs.join(own, F.col("id").eqNullSafe(F.col("t_id")) & (F.col("h") == F.col("t_h")))
            .join(other, F.col("f_id").eqNullSafe(F.col("o_id")) & (F.col("f_h") == F.col("o_h"))))
    one_text = F.col("id").eqNullSafe(F.col("f_id")) & (F.col("h") == F.col("f_h"))
    compared = let(words(F.col("own")), lambda w: let(words(F.col("other")), lambda o: runs(
        matches(w, o, F.col("found"), one_text, size, min_words))))
    joined = (both.select("id", "h", compared.alias("found")).where("size(found) > 0")
              .groupBy("id", "h").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))
              .select(F.col("id").alias("e_id"), F.col("h").alias("e_h"), F.filter(
                  runs(F.col("found")), lambda r: r["e"] - r["s"] >= min_words).alias("runs")))
    joined = materialise(joined.where("size(runs) > 0"), "runs")

    # 5. places that share fewer words with the first one: the passages around them, by their bytes
    met = F.exists(F.coalesce("runs", F.array().cast("array<struct<s:int,e:int>>")), lambda r: (r["s"] <= F.col("at")) & (r["e"] >= F.col("at") + size))
    alone = later.join(joined, F.col("id").eqNullSafe(F.col("e_id")) & (F.col("h") == F.col("e_h")), "left").where(~met).select("hash", "id", "h", "at")
    alone = materialise(alone, "alone")
    several = alone.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    places = materialise(alone.join(several, "hash", "left_semi").select("id", "h", "at").distinct(), "places")
    passages = places.join(own, F.col("id").eqNullSafe(F.col("t_id")) & (F.col("h") == F.col("t_h"))).select(
        "id", "h", F.explode(let(words(F.col("own")), lambda w: around(w, F.col("at"), size, min_words))).alias("x")).select("id", "h", "x.*").distinct()
    passages = materialise(passages, "passages")
    twice = passages.groupBy("bytes").agg(F.count("*").alias("n"), F.min(F.struct("id", "h", "s")).alias("f")).where("n > 1")
    is_first = F.col("id").eqNullSafe(F.col("f.id")) & (F.col("h") == F.col("f.h")) & (F.col("s") - F.col("f.s") < min_words)
    repeated = passages.join(twice, "bytes").where(~is_first).groupBy("id", "h").agg(
        F.collect_set(F.struct("s", (F.col("s") + min_words).alias("e"))).alias("found"))
    repeated = repeated.select(F.col("id").alias("e_id"), F.col("h").alias("e_h"), runs(F.col("found")).alias("runs"))
    joined = materialise(joined.union(repeated).groupBy("e_id", "e_h").agg(F.flatten(F.collect_list("runs")).alias("found")).select(
        "e_id", "e_h", runs(F.col("found")).alias("runs")), "runs")
    spans = let(words(F.col("own")), lambda w: byte_spans(w, F.col("runs"), F.octet_length("own")))
    cut_out = (beside(own, joined, F.col("t_id").eqNullSafe(F.col("e_id")) & (F.col("t_h") == F.col("e_h")), "inner")
               .select("e_id", "e_h", spans.alias("runs")))
    whole = (beside(keyed, copies, F.col("id").eqNullSafe(F.col("c_id")) & (F.col("h") == F.col("c_h")), "inner")
             .select("c_id", "c_h", F.array(F.struct(F.lit(0).alias("s"), F.col("size").alias("e"), n_words(F.col("text")).alias("n"))).alias("runs"))
             .distinct())
    edits = materialise(cut_out.union(whole), "spans")
    edits = materialise(edits.select("e_id", "e_h", F.filter("runs", lambda r: r["n"] >= min_words).alias("runs")).where("size(runs) > 0"), "edits")

    # 6. cut the runs that are long enough
    n = edits.count()
    text, raw = F.col(text_col), F.col(text_col).cast("binary")
    cuts = F.coalesce(F.col("runs"), F.array().cast("array<struct<s:int,e:int,n:int>>"))
    keep = [F.col(c) for c in df.columns if c not in (text_col, "removed_spans", "removed_words")]
    found = df.join(F.broadcast(edits) if n <= BROADCAST_ROWS else edits,
                     F.col(id_col).eqNullSafe(F.col("e_id")) & (F.xxhash64(text_col) == F.col("e_h")), "left")
    out = found.select(*keep, let(cuts, lambda r: F.struct(
        F.when(F.size(r) > 0, _cut(raw, r)).otherwise(text).alias("text"),
        F.transform(r, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias("spans"),
        F.aggregate(r, F.lit(0), lambda a, x: a + x["n"]).alias("words"))).alias("__cut"))
    return out.select(*keep, F.col("__cut.text").alias(text_col), F.col("__cut.spans").alias("removed_spans"),
                      F.col("__cut.words").alias("removed_words"))
