"""Line dedup by a segment-partition edit join, with DataFrame functions only.

Lines within TAU edits: the shorter one is cut into TAU + 1 segments, of which at least
one stands unchanged in the longer one. Each line puts its segments into an index by
length and number, and looks up its substrings for the lengths up to TAU below its own.
By the multi-match rule a substring may start only where edits left of it and right of
it can still add up to TAU: with TAU = 2 that is 12 lookups whatever the length.
Candidates are compared from where they first to where they last differ, by a
bit-parallel automaton over a band of 2 * TAU + 1 diagonals.

A line goes if its text, or a text within TAU edits, stands in an earlier document or
further up. What decides is the first place of each text, so there are no chains to
follow. Equal lines are one before any join.

Keys are counted first, and only lines that share one go on. Those get two signatures,
parities of their words and of their pairs of letters: edits change few of them, so lines
that only share a long segment do not meet. Lines that are a change of one line of their
key by up to TAU / 2 edits call it home. Lines of one home are all linked to each other,
which is counted and not joined; pairs are formed between lines of different homes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifline.llm.common import apart, drop_staged, free_shuffles
from motifline.plans.blocks import stage

TAU = 2
#: Shorter lines are compared for equality only.
LEAST = 40
#: Parity bits that an edit can change: it may make one word of two, or two of one.
BITS_AN_EDIT = 3
#: Pairs of neighbouring letters that an edit can change: a replaced letter stood in two and stands in two.
PAIRS_AN_EDIT = 4
LONGEST = 24  # steps of the search for the first difference: lines of up to 2 ** 24 code points


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def lines_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """Lines that are not blank: _row and _tag of the row, its order, place and line, and two hashes of the line.

    Rows of one id and text are one; a null id comes after all others.
    """
    # Hashes of the text come first: beside the lines they would be worked out for each line.
    whole = docs.select(F.col("doc_id").isNull().alias("_none"), "doc_id", F.xxhash64("doc_id", text).alias("_row"), F.hash(text).alias("_tag"), F.split(F.col(text), "\n").alias("_lines"))
    kept = whole.select("_none", "doc_id", "_row", "_tag", F.posexplode("_lines").alias("place", "line")).where(F.trim("line") != "")
    return kept.select(
        F.struct("_none", "doc_id", "_row", "place").alias("at"), "_row", "_tag", "place", "line", F.xxhash64("line").alias("id"), F.xxhash64(F.lit(1), "line").alias("id2")
    )


def signature(line: Column) -> Column:
    """64 parities of the line's words."""
    bits = F.transform(F.split(line, " "), lambda w: F.call_function("shiftleft", _long(1), F.pmod(F.hash(w), F.lit(64))))
    return F.aggregate(bits, _long(0), lambda a, b: a.bitwiseXOR(b))


def letter_signature(line: Column) -> Column:
    """64 parities of the line's pairs of neighbouring letters; the last letter stands alone."""

    def parities(letters: Column) -> Column:
        after = F.slice(letters, 2, F.size(letters))
        bits = F.zip_with(letters, after, lambda a, b: F.call_function("shiftleft", _long(1), F.pmod(F.hash(a, b), F.lit(64))))
        return F.aggregate(bits, _long(0), lambda a, b: a.bitwiseXOR(b))

    return _given(F.split(line, ""), parities)


def _segment(length: Column, i: Column, tau: int) -> tuple[Column, Column]:
    """First place (from 1) and length of segment i of tau + 1: the last ones are longer by one if need be."""
    parts = tau + 1
    short = F.call_function("div", length, F.lit(parts)).cast("int")
    longer = (length % parts).cast("int")
    before = F.greatest(F.lit(0), i - (F.lit(parts) - longer))
    size = short + F.when(i >= F.lit(parts) - longer, 1).otherwise(0)
    return short * i + before + 1, size


def keys_of(texts: DataFrame, tau: int = TAU, least: int = LEAST) -> DataFrame:
    """(key, id, own): the substrings of each line (id, line, n) that can equal a segment of a line up to `tau` shorter.

    own says that the substring is a segment of the line itself. Lines of one length look each
    other up. Up to three edits between them hold one insertion and one deletion at most, and one
    of the two ways the insertion comes first: nothing is then shifted to the left.
    """
    places = []
    for gap in range(tau + 1):
        for i in range(tau + 1):
            low, high = max(-i, gap - (tau - i)) if gap or tau > 3 else 0, min(i, gap + (tau - i))
            places += [(gap, i, shift) for shift in range(low, high + 1)]
    # Places first: short expressions over plain columns are compiled, one long one for each place is not.
    table = F.array(*[F.struct(F.lit(g).alias("gap"), F.lit(i).alias("i"), F.lit(s).alias("shift")) for g, i, s in places])
    rows = texts.select("id", "line", "n", F.inline(table)).withColumn("length", F.col("n") - F.col("gap"))
    start, size = _segment(F.col("length"), F.col("i"), tau)
    rows = rows.select("id", "line", "n", "length", "i", (start + F.col("shift")).alias("start"), size.alias("size"), ((F.col("gap") == 0) & (F.col("shift") == 0)).alias("own"))
    inside = rows.where((F.col("length") >= least) & (F.col("start") >= 1) & (F.col("start") + F.col("size") - 1 <= F.col("n")))
    return inside.select(F.xxhash64("length", "i", F.substring("line", F.col("start"), F.col("size"))).alias("key"), "id", "own")


def _given(value: Column, use) -> Column:
    """`use` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _first_difference(a: Column, b: Column) -> Column:
    """Code points that two strings have in common from the start, by halving steps."""
    steps = F.array(*[F.lit(1 << s) for s in range(LONGEST - 1, -1, -1)])
    most = F.least(F.char_length(a), F.char_length(b))

    def step(n: Column, s: Column) -> Column:
        fits = (n + s <= most) & (F.substring(a, n + 1, s) == F.substring(b, n + 1, s))
        return F.when(fits, n + s).otherwise(n)

    return F.aggregate(steps, F.lit(0), step)


def within(a: Column, b: Column, tau: int = TAU) -> Column:
    """Are two strings within `tau` edits?

    Bit d + tau of mask e says that the first j + d letters of a and the first j of b are
    within e edits; the masks of all e stand side by side in one number.
    """
    width = 2 * tau + 1
    full = (1 << width) - 1
    shift = width + 1  # a free bit between masks

    def mask(state: Column, e: int) -> Column:
        return F.shiftright(state, e * shift).bitwiseAND(_long(full))

    def grown(lower: Column, own: Column) -> Column:
        """Deletions from a: the next diagonal, without a letter of b."""
        return own.bitwiseOR(F.shiftleft(lower, 1).bitwiseAND(_long(full)))

    first = [1 << tau]
    for _ in range(tau):
        first.append(first[-1] | (first[-1] << 1) & full)
    start = _long(sum(v << (e * shift) for e, v in enumerate(first)))

    def last(x: Column, y: Column) -> Column:
        """Masks after all letters of y."""

        def step(masks: Column, j: Column) -> Column:
            letter = F.get(y, j)
            equal = _long(0)
            for d in range(-tau, tau + 1):
                hit = (j + d >= 0) & (F.get(x, j + d) == letter)
                equal = equal.bitwiseOR(F.when(hit, _long(1 << (d + tau))).otherwise(_long(0)))
            before, out = None, _long(0)
            for e in range(tau + 1):
                own = mask(masks, e).bitwiseAND(equal)
                if e:
                    lower = mask(masks, e - 1)
                    own = grown(before, own.bitwiseOR(lower).bitwiseOR(F.shiftright(lower, 1)))
                before = own
                out = out.bitwiseOR(F.shiftleft(own, e * shift))
            return out

        places = F.when(F.size(y) > 0, F.sequence(F.lit(0), F.size(y) - 1)).otherwise(F.expr("cast(array() as array<int>)"))
        return F.aggregate(places, start, step)

    def letters(s: Column) -> Column:
        return F.when(F.char_length(s) > 0, F.split(s, "")).otherwise(F.expr("cast(array() as array<string>)"))

    def reached(v: Column) -> Column:
        gap = F.size(v["x"]) - F.size(v["y"])
        bit = F.call_function("shiftright", mask(last(v["x"], v["y"]), tau), F.greatest(F.lit(0), gap + tau)).bitwiseAND(_long(1))
        return F.when(F.abs(gap) > tau, F.lit(False)).otherwise(bit == 1)

    return _given(F.struct(letters(a).alias("x"), letters(b).alias("y")), reached)


def near(a: Column, b: Column, tau: int = TAU) -> Column:
    """Are two lines within `tau` edits? What they share at both ends is cut off first."""

    def tails(v: Column) -> Column:
        rest = F.lit(1 << 30)
        return F.struct(F.substring(v["a"], v["n"] + 1, rest).alias("a"), F.substring(v["b"], v["n"] + 1, rest).alias("b"))

    def heads(v: Column) -> Column:
        n = _first_difference(F.reverse(v["a"]), F.reverse(v["b"]))
        return _given(F.struct(v["a"].alias("a"), v["b"].alias("b"), n.alias("n")), cut)

    def cut(v: Column) -> Column:
        one = F.lit(1)
        middle = F.struct(F.substring(v["a"], one, F.char_length(v["a"]) - v["n"]).alias("a"), F.substring(v["b"], one, F.char_length(v["b"]) - v["n"]).alias("b"))
        return _given(middle, lambda m: within(m["a"], m["b"], tau))

    start = F.struct(a.alias("a"), b.alias("b"), _first_difference(a, b).alias("n"))
    return _given(_given(start, tails), heads)


def _apart_in(a: str, b: str) -> Column:
    """Number of bits in which two signatures differ."""
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def members_of(texts: DataFrame, tau: int = TAU, least: int = LEAST) -> DataFrame:
    """(key, id, own): the lines that meet another under a key of their index; own says that the key is a segment of the line.

    A key is only counted here, so this grows with the lines and not with what they share.
    """
    rows = keys_of(texts.where(F.col("n") >= least), tau, least).repartition("key")
    shared = rows.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.max("own").alias("any_own"))
    shared = shared.where("low <> high and any_own").select("key")
    return rows.join(shared.hint("shuffle_hash"), "key").distinct()


def homes_of(members: DataFrame, held: DataFrame, tau: int = TAU) -> DataFrame:
    """(id, home): the lines that are within tau / 2 edits of a line that meets them, the most frequent one of its key.

    Lines of one home are within tau edits of each other, so their links need no join.
    A line that many call home and that has none itself is its own home.
    """
    half = tau // 2
    frequent = members.join(held.select("id", "times"), "id").groupBy("key").agg(F.max(F.struct("times", "id")).alias("top"))
    asked = members.join(frequent, "key").select("id", F.col("top.id").alias("home")).where("id <> home").distinct()
    signs = held.select("id", "words", "letters", "line")
    there = signs.toDF("home", "words_h", "letters_h", "line_h")
    few = (_apart_in("words", "words_h") <= BITS_AN_EDIT * half) & (_apart_in("letters", "letters_h") <= PAIRS_AN_EDIT * half)
    met = asked.join(signs, "id").join(there, "home").where(few & near(F.col("line"), F.col("line_h"), half))
    # Of several homes the most frequent; lines of one hash are told apart later, so they have none.
    best = met.join(held.select(F.col("id").alias("home"), "times"), "home").groupBy("id").agg(F.max(F.struct("times", "home")).alias("top"))
    return best.select("id", F.col("top.home").alias("home"))


def candidates(members: DataFrame, held: DataFrame, tau: int = TAU) -> DataFrame:
    """Pairs (a, b) of ids of different homes that share a key and whose signatures are near enough.

    `held` has id, home, words and letters.
    """
    seen = members.join(held.select("id", "home", "words", "letters"), "id")
    mixed = seen.groupBy("key").agg(F.min("home").alias("low"), F.max("home").alias("high")).where("low <> high").select("key")
    seen = seen.join(mixed.hint("shuffle_hash"), "key")
    index = seen.where("own").drop("own")
    probes = seen.drop("own").withColumnsRenamed({c: f"{c}_b" for c in ("id", "home", "words", "letters")})
    few = (_apart_in("words", "words_b") <= BITS_AN_EDIT * tau) & (_apart_in("letters", "letters_b") <= PAIRS_AN_EDIT * tau)
    met = index.join(probes, "key").where((F.col("home") != F.col("home_b")) & few)
    return met.select(F.least("id", "id_b").alias("a"), F.greatest("id", "id_b").alias("b")).distinct()


def similar(texts: DataFrame, tau: int = TAU, least: int = LEAST) -> DataFrame:
    """Per line with others within `tau` edits: id, id2, the number of these links, and first, the earliest place of those lines and its own.

    `texts` has one row per line: id, id2, at, times, line and its length n.
    """
    spark = texts.sparkSession
    members = stage(members_of(texts, tau, least))
    free_shuffles(spark)
    # Two lines of one 64-bit hash both take part here, so nothing rests on the hash.
    asked = members.select("id").distinct()
    signed = texts.join(asked.hint("shuffle_hash"), "id").select("id", "id2", "at", "times", "line")
    held = stage(signed.withColumns({"words": signature(F.col("line")), "letters": letter_signature(F.col("line"))}))
    free_shuffles(spark)
    alone = held.groupBy("id").agg(F.count("*").alias("lines")).where("lines = 1").select("id")
    found = homes_of(members, held, tau).join(alone, "id").join(alone.withColumnRenamed("id", "home"), "home").select("id", "home")
    homes = stage(found)
    named = held.join(homes, "id", "left").withColumn("home", F.coalesce("home", "id"))
    pairs = stage(candidates(members, named, tau))
    one = held.select(F.col("id").alias("a"), F.col("id2").alias("a2"), F.col("at").alias("at_a"), F.col("line").alias("line_a"))
    two = held.select(F.col("id").alias("b"), F.col("id2").alias("b2"), F.col("at").alias("at_b"), F.col("line").alias("line_b"))
    both = pairs.join(one, "a").join(two, "b").where(near(F.col("line_a"), F.col("line_b"), tau))
    links = stage(both.select("a", "a2", "at_a", "b", "b2", "at_b"))
    there = links.select(F.col("a").alias("id"), F.col("a2").alias("id2"), F.lit(1).cast("long").alias("links"), F.least("at_a", "at_b").alias("first"))
    back = links.select(F.col("b").alias("id"), F.col("b2").alias("id2"), F.lit(1).cast("long").alias("links"), F.least("at_a", "at_b").alias("first"))
    groups = named.groupBy("home").agg((F.count("*") - 1).alias("links"), F.min("at").alias("first"), F.min("id").alias("low"), F.max("id").alias("high"))
    groups = groups.where("low <> high").select("home", "links", "first")
    inside = named.select("id", "id2", "home").join(groups, "home").select("id", "id2", "links", "first")
    return there.union(back).union(inside).groupBy("id", "id2").agg(F.sum("links").alias("links"), F.min("first").alias("first"))


def judged_rows(docs: DataFrame, tau: int = TAU, least: int = LEAST, text: str = "text") -> DataFrame:
    """Per row (_row, _tag) with lines: n_lines, n_exact and n_near lines that go, n_links of its
    different lines to other texts, and the places that go."""
    lines = lines_of(docs, text)
    first = lines.groupBy("id", "id2").agg(F.min("at").alias("at"), F.count("*").alias("times"), F.first("line").alias("line"))
    texts = stage(first.withColumn("n", F.char_length("line")))
    free_shuffles(docs.sparkSession)
    found = similar(texts, tau, least)
    # A line that stands once and is like no other stays, so it needs no verdict.
    # Staged, so that the join below is a plain one whose hot lines Spark can split.
    places = texts.select("id", "id2", "times", F.col("at").alias("first_at")).join(found, ["id", "id2"], "left").where("times > 1 or links is not null")
    verdict = stage(places.select("id", "id2", "first_at", "links", (F.col("first") < F.col("first_at")).alias("later")))
    drop_staged(texts)
    free_shuffles(docs.sparkSession)
    exact = F.coalesce(F.col("at") != F.col("first_at"), F.lit(False))
    later = F.coalesce("later", F.lit(False))
    each = lines.select("_row", "_tag", "at", "place", "id", "id2").join(verdict.hint("shuffle_hash"), ["id", "id2"], "left").select(
        "_row", "_tag", "place", exact.alias("exact"), (~exact & later).alias("near"), F.when(~exact, F.coalesce("links", F.lit(0))).otherwise(0).alias("links")
    )
    # Repeated rows of one id and text count once.
    once = each.repartition("_row", "_tag").dropDuplicates(["_row", "_tag", "place"])
    return once.groupBy("_row", "_tag").agg(
        F.count("*").alias("n_lines"),
        F.count_if("exact").alias("n_exact"),
        F.count_if("near").alias("n_near"),
        F.sum("links").alias("n_links"),
        F.collect_list(F.when(F.col("exact") | F.col("near"), F.col("place"))).alias("_gone"),
    )


def deduped(docs: DataFrame, tau: int = TAU, least: int = LEAST, text: str = "text") -> DataFrame:
    """`docs` with the text without the lines that go, and n_lines, n_exact, n_near, n_links.

    Blank lines stay. A null or blank text stays as it is, with zeros. Repeated rows of
    one id and text keep the same lines.
    """
    judged = judged_rows(docs, tau, least, text)
    keyed = docs.withColumns({"_r": F.xxhash64("doc_id", text), "_t": F.hash(text)})
    rows = keyed.join(judged.hint("shuffle_hash"), (F.col("_r") == F.col("_row")) & (F.col("_t") == F.col("_tag")), "left")
    left = F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.array_contains("_gone", i))
    changed = F.when(F.size("_gone") > 0, F.array_join(left, "\n")).otherwise(F.col(text))
    counts = {f"_{c}": F.coalesce(c, F.lit(0)).cast("long") for c in ("n_lines", "n_exact", "n_near", "n_links")}
    return rows.withColumns({"_new": changed, **counts})


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_exact, n_near, n_links, and the length and SHA-256 of the text that stays."""
    return deduped(docs).select(
        "doc_id",
        *[F.col(f"_{c}").alias(c) for c in ("n_lines", "n_exact", "n_near", "n_links")],
        F.coalesce(F.char_length("_new"), F.lit(0)).cast("long").alias("n_chars_left"),
        F.sha2(F.coalesce("_new", F.lit("")), 256).alias("text_sha256"),
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, their texts without repeated lines; a row of which no line is left goes.

    n_chars, if there, follows the text. Nulls, blank texts and repeated rows as in
    `deduped`; of equal lines the first place by doc_id and line stays. Other columns pass,
    whatever their names. An empty table stays empty.
    """

    def run(docs: DataFrame) -> DataFrame:
        rows = deduped(docs).where((F.col("_n_lines") == 0) | (F.col("_n_exact") + F.col("_n_near") < F.col("_n_lines")))
        changed = {"text": F.col("_new")} | ({"n_chars": F.char_length("_new").cast("long")} if "n_chars" in docs.columns else {})
        return rows.select(*[changed[c].alias(c) if c in changed else docs[c] for c in docs.columns])

    return apart(docs, ("doc_id", "text", "n_chars"), run)
