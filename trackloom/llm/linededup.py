"""Lines that repeat within or across documents, exactly or within a few edits; in built-in expressions only.

Equal lines meet by a 128-bit hash, combined before the shuffle. Lines within ``tau`` edits are found as in a
segment-partition join: a line is cut into tau + 1 even segments; if two lines are within tau edits, the longer one holds
some segment of the shorter unchanged, at a place that their lengths confine to a few. So every distinct line is dealt
under hashes of (length, number, content) of its own segments, which index it, and of the substrings by which it may find
lines of its own length down to tau less. Only keys under which different lines meet go on; there, pairs are first told
apart by a signature of their character pairs, and then verified by a banded bit-parallel automaton.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import fresh_name
from trackloom.plans.session import passing_tables, scratch_path, settle

#: Most ids that are broadcast to fetch the texts of candidates, 16 bytes each; beyond it they are joined.
BROADCAST_IDS = 1_000_000
#: A line that more than one in so many rows hold is common.
COMMON_SHARE = 1024
_HALF = 1 << 31


def _segment(length: Column, i: int, parts: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i of ``parts``; the last ones are longer by one if it does not divide."""
    base, rest = F.floor(length / parts).cast("int"), F.pmod(length, F.lit(parts))
    longer = F.greatest(F.lit(i) - (F.lit(parts) - rest), F.lit(0))
    return (base * i + longer + 1).cast("int"), (base + (F.lit(i) >= F.lit(parts) - rest).cast("int")).cast("int")


def segment_keys(line: Column, length: Column, tau: int) -> Column:
    """Array of hashed keys: the tau + 1 under which a line is indexed, which also find lines of its length, then the others
    under which lines of the same or a smaller length within ``tau`` edits may be found.

    Before segment i (from 0) at most i edits can have happened and after it at most tau - i; the difference of the
    lengths ties both together. Only shifts that satisfy both bounds are probed.
    """
    own, others = [], []
    plain, octets = F.octet_length(line) == F.length(line), line.cast("binary")

    def part(start: Column, size: Column) -> Column:
        # characters of a text are found by counting, bytes at once; the hash is of the same bytes
        return F.when(plain, F.substr(octets, start, size)).otherwise(F.substr(line, start, size).cast("binary"))

    for shorter in range(tau + 1):
        other = (length - shorter).cast("int")
        for i in range(tau + 1):
            start, size = _segment(other, i, tau + 1)
            for shift in range(max(-i, shorter - (tau - i)), min(i, shorter + (tau - i)) + 1):
                key = F.xxhash64(other, F.lit(i), part((start + shift).cast("int"), size))
                (others if shorter or shift else own).append(key)
    return F.array(*own, *others)


def signature(line: Column) -> Column:
    """64 bits, each the parity of how many neighbouring pairs of characters fall to it; an edit changes at most 4 of them."""
    pairs = F.regexp_extract_all(line, F.lit("(?s)(?=(..))"), F.lit(1))
    bit = lambda p: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.hash(p), F.lit(64)))
    return F.aggregate(pairs, F.lit(0).cast("bigint"), lambda bits, p: bits.bitwiseXOR(bit(p)))


def characters(text: Column) -> Column:
    """Array of the code points of a text."""
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def within_edits(a: Column, b: Column, tau: int) -> Column:
    """True if the Levenshtein distance of two arrays of characters is at most ``tau``; banded and bit-parallel.

    State e is a word whose bit d + tau says that the first i + d characters of ``a`` become the first i of ``b`` by at most
    e edits. A character of ``b`` moves all 2 tau + 1 diagonals of a state at once: kept where it matches, and from state
    e - 1 by a substitution (same bit), an insertion (one lower) or a deletion (one higher). The arrays should be columns,
    as the loop reads them for every character; tau is at most 14.
    """
    full = (1 << (2 * tau + 1)) - 1
    begin = F.struct(
        F.lit(0).alias("i"), *[F.lit(sum(1 << (tau + d) for d in range(e + 1))).alias(f"r{e}") for e in range(tau + 1)]
    )

    def step(acc: Column, c: Column) -> Column:
        same = [F.when(F.get(a, acc["i"] + d) == c, 1 << (d + tau)).otherwise(0) for d in range(-tau, tau + 1)]
        match = sum(same[1:], same[0])
        states = [acc["r0"].bitwiseAND(match)]
        for e in range(1, tau + 1):
            below = acc[f"r{e - 1}"]
            state = acc[f"r{e}"].bitwiseAND(match).bitwiseOR(below).bitwiseOR(F.shiftright(below, 1))
            states.append(state.bitwiseOR(F.shiftleft(states[-1], 1)).bitwiseAND(F.lit(full)))
        return F.struct((acc["i"] + 1).alias("i"), *[s.alias(f"r{e}") for e, s in enumerate(states)])

    gap = F.size(a) - F.size(b)
    last = F.aggregate(b, begin, step)[f"r{tau}"]
    reached = F.call_function("shiftright", last, gap + tau).bitwiseAND(F.lit(1)) == 1
    return F.when(F.abs(gap) > tau, False).otherwise(reached)


def lines_of(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """(doc_id, pos, line, h1, h2): the lines, without spaces around them, of at least ``min_chars`` characters of rows that have an id."""
    rows = docs.where(F.col(doc_id).isNotNull()).select(
        F.col(doc_id).alias("doc_id"), F.posexplode_outer(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("pos", "line")
    )
    rows = rows.withColumn("line", F.trim("line")).where(F.length("line") >= min_chars)
    return rows.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit("second"), "line")})


def first_lines(lines: DataFrame) -> DataFrame:
    """(h1, h2, doc_id, pos, rows): where each distinct line occurs first, by document id and then line number.

    Place and id are one decimal meanwhile, since the minimum of a number combines before the shuffle without a sort.
    """
    big = "decimal(38,0)"
    half, lift = F.lit(_HALF).cast(big), F.lit(str(1 << 63)).cast(big)  # ids from 0 on, whatever their sign
    place = (F.col("doc_id").cast(big) + lift) * half + F.col("pos").cast(big)
    first = lines.groupBy("h1", "h2").agg(F.min(place.cast(big)).alias("_at"), F.count(F.lit(1)).alias("rows"))
    pos = F.pmod("_at", half).cast(big)
    doc = ((F.col("_at") - pos) / half).cast(big) - lift
    return first.select("h1", "h2", doc.cast("bigint").alias("doc_id"), pos.cast("int").alias("pos"), "rows")


def segment_meetings(lines: DataFrame, tau: int) -> DataFrame:
    """(key, h1, indexed) of distinct lines, for the keys under which lines of different h1 meet; one shuffle of keys.

    h1 without its lowest bit and whether the line is indexed there travel as one number. The smallest and the largest h1 of a
    key tell whether lines differ; rows of a key are streamed for it, and spill if they are many.
    """
    lines = lines.select("line").distinct().select("line", F.xxhash64("line").bitwiseAND(F.lit(-2)).alias("h1"))
    keys = segment_keys(F.col("line"), F.length("line").cast("int"), tau)
    dealt = lines.select("h1", F.posexplode_outer(keys).alias("i", "key"))
    dealt = dealt.select("key", F.col("h1").bitwiseOR((F.col("i") <= tau).cast("bigint")).alias("v"))
    own = F.shiftright("v", 1)
    of_key = Window.partitionBy("key")
    met = dealt.withColumns({"low": F.min(own).over(of_key), "high": F.max(own).over(of_key)}).where("low <> high")
    return met.select("key", F.col("v").bitwiseAND(F.lit(-2)).alias("h1"), (F.col("v").bitwiseAND(F.lit(1)) == 1).alias("indexed"))


def near_repeats(lines: DataFrame, first: DataFrame, tau: int) -> DataFrame:
    """(doc_id, pos) of first occurrences that are within ``tau`` edits of a line that occurs earlier."""
    met = settle(segment_meetings(lines, tau), "segment-meetings")
    ids = settle(met.select("h1").distinct(), "line-ids")
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = lines.withColumn("_h1", F.col("h1")).withColumn("h1", F.col("h1").bitwiseAND(F.lit(-2)))
    texts = texts.join(wanted, "h1", "left_semi").select("h1", F.col("_h1"), "h2", "line").distinct()
    # the characters are written, as the loop over them would otherwise split the text again at every step
    texts = texts.select("h1", "_h1", "h2", characters(F.col("line")).alias("chars"), signature(F.col("line")).alias("sig"))
    places = first.select(F.col("h1").alias("_h1"), "h2", F.struct("doc_id", "pos").alias("place"))
    texts = settle(texts.join(places, ["_h1", "h2"]), "line-texts")
    known = met.join(texts.select("h1", "sig", "place", F.size("chars").alias("size")), "h1")
    sides = [known.select("key", "indexed", *[F.col(c).alias(f"{x}_{c}") for c in ("sig", "place", "size")]) for x in "ab"]
    near = F.bit_count(F.col("a_sig").bitwiseXOR(F.col("b_sig"))) <= 4 * tau
    near &= F.abs(F.col("a_size") - F.col("b_size")) <= tau
    pairs = sides[0].where("indexed").drop("indexed").join(sides[1].drop("indexed"), "key")
    pairs = pairs.where((F.col("a_place") != F.col("b_place")) & near)
    pairs = pairs.select(F.least("a_place", "b_place").alias("a"), F.greatest("a_place", "b_place").alias("b")).distinct()
    ends = [texts.select(F.col("place").alias(x), F.col("chars").alias(f"{x}_chars")) for x in "ab"]
    both = pairs.join(ends[0], "a").join(ends[1], "b")
    return both.where(within_edits(F.col("a_chars"), F.col("b_chars"), tau)).select("b.doc_id", "b.pos").distinct()


def _repeats(lines: DataFrame, first: DataFrame) -> DataFrame:
    """(doc_id, pos) of lines that are equal to one that occurs earlier.

    ``first`` is small beside the lines, as it counts only here if a line occurs again. The commonest lines, fewer than
    COMMON_SHARE, are met where they lie, so no key of the shuffled join holds more than that share of the rows.
    """
    again = first.where("rows > 1").select("h1", "h2", "rows", F.col("doc_id").alias("_doc"), F.col("pos").alias("_pos"))
    total = first.agg(F.sum("rows")).first()[0] or 0
    common = F.col("rows") * COMMON_SHARE > total
    few, others = F.broadcast(again.where(common).drop("rows")), again.where(~common).drop("rows")
    rest = lines.join(few.select("h1", "h2"), ["h1", "h2"], "left_anti")
    met = lines.join(few, ["h1", "h2"]).unionByName(rest.join(others, ["h1", "h2"]))
    return met.where((F.col("doc_id") != F.col("_doc")) | (F.col("pos") != F.col("_pos"))).select("doc_id", "pos")


def lost_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tau: int = 2, min_chars: int = 20, near_chars: int = 40
) -> DataFrame:
    """(doc_id, gone array<int>): line numbers, from 0, of the lines that go, for the documents that lose any.

    Of equal lines the first stays, by document id and line number. Of lines with ``near_chars`` characters or more, one also
    goes if a line that occurs earlier is within ``tau`` edits. Lines of less than ``min_chars`` are never compared and stay.
    What is found on the way is removed again.
    """
    lines = lines_of(docs, doc_id, text, min_chars)
    with passing_tables(docs.sparkSession):
        places = settle(lines.select("doc_id", "pos", "h1", "h2"), "line-places")
        first = settle(first_lines(places), "first-lines")
        near = near_repeats(lines.where(F.length("line") >= near_chars), first, tau)
        lost = _repeats(places, first).unionByName(near.select("doc_id", "pos")).distinct()
        grouped = lost.groupBy("doc_id").agg(F.sort_array(F.collect_list("pos")).alias("gone"))
        path = scratch_path(docs.sparkSession, "lost-lines")
        grouped.write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def _with_lost(docs: DataFrame, lost: DataFrame, doc_id: str, name: str) -> DataFrame:
    """``docs`` with the lost lines of each in column ``name``; texts stay where they are unless the lists are too many."""
    key = fresh_name(docs, "lost_id")
    lost = lost.select(F.col("doc_id").alias(key), F.col("gone").alias(name))
    if (lost.agg(F.sum(F.size(name))).first()[0] or 0) <= BROADCAST_IDS:
        lost = F.broadcast(lost)
    return docs.join(lost, F.col(f"`{doc_id}`") == F.col(key), "left").drop(key)


def line_decisions(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tau: int = 2, min_chars: int = 20, near_chars: int = 40
) -> DataFrame:
    """``docs``' id, n_lines and dropped, the numbers (from 0) of the lines that go, for every row.

    Null text is one empty line. Rows without an id keep all lines. Ids are whole numbers and taken to be unique: rows that
    repeat one share the decision by line number. An empty table gives an empty result; other columns are not read.
    """
    count = F.size(F.split(F.coalesce(F.col(text), F.lit("")), "\n"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), count.alias("n_lines"))
    found = _with_lost(rows, lost_lines(docs, doc_id, text, tau, min_chars, near_chars), "doc_id", "gone")
    gone = F.coalesce(F.filter("gone", lambda i: i < F.col("n_lines")), F.array().cast("array<int>"))
    return found.select("doc_id", "n_lines", gone.alias("dropped"))


def drop_repeated_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tau: int = 2, min_chars: int = 20, near_chars: int = 40
) -> DataFrame:
    """``docs`` with the repeated lines taken out of the text; all rows stay, a text may become empty.

    Rules as in ``line_decisions``. A text that loses no line stays as it is, null included. Columns may have any names.
    """
    gone = fresh_name(docs, "lost")
    rows = _with_lost(docs, lost_lines(docs, doc_id, text, tau, min_chars, near_chars), doc_id, gone)
    lines = F.split(F.col(f"`{text}`"), "\n")
    # a lambda's place comes with each line, so the text is split once
    stay = F.filter(lines, lambda line, i: ~F.array_contains(gone, i))
    kept = F.when(F.col(gone).isNull(), F.col(f"`{text}`")).otherwise(F.array_join(stay, "\n"))
    return rows.select(*[kept.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
