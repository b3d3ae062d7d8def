"""Phrase collocations from a weighted de Bruijn graph of the corpus, per language.

Each run of ``LONGEST`` words inside a piece is an edge that leads from the node of
its first words to the node of its last words; its weight is how often it stands in
the corpus. Shorter phrases are not counted in the texts. A node's count is the
weight that flows out of it, plus the pieces that end in it, where no edge goes on.

Only the edges are shuffled, by the node that they leave, so that edges and nodes
are summed in the same place; the edges of a node with a large share of all are
dealt out one by one. A task sends the edges that go to one place as one text. What occurs often enough is then a small graph: its unary
paths are compacted, and the counts along a path say which phrases are only parts
of longer ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelspring.llm.shared import Workspace, spread_join, union_all
from labelspring.llm.tokens import _mixed

#: Words of an edge.
LONGEST = 3
#: A phrase that occurs less often is none.
LEAST = 10
#: A phrase goes when a longer one has this share of its occurrences, in hundredths.
COVERED = 50
#: Words that a task holds at once, different ones among them, and bytes of a text that it splits at once.
WORDS_AT_ONCE, NUMBERS_AT_ONCE, PART = 2 << 20, 1 << 20, 2 << 20
#: A node with more than one in HOT of all edges' rows is dealt out edge by edge.
HOT = 4000
#: And with at least so many rows, of which a task sees an eighth or more.
LEAST_HOT = 64
#: Rows of the tasks' graphs that are summed up together.
SUMMED_AT_ONCE = 1 << 16
#: Rows of a language that are ranked in one task.
RANKED_AT_ONCE = 200_000

GRAMS = "lang string, gram string, n long"
PLACED = "lang string, place long, hot boolean, grams string, counts binary"
#: What ends a piece becomes a byte that no text has, space and tab become a space.
_END = b"\xff"
_PARTED = bytes(
    255 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b
    for b in range(256)
)
_BETWEEN = re.compile(rb"[ \t.,;:!?\n\x0b\x0c\r]")


def _words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text and the ends of its pieces, a part of it at a time; no word is cut."""
    at = 0
    while at < len(text):
        cut = _BETWEEN.search(text, at + PART)
        end = cut.start() if cut else len(text)
        yield text[at:end].translate(_PARTED).replace(_END, b" \xff ").split()
        at = end


class _Numbers(dict):
    """Words numbered from 2 on, in the order of their coming; 1 ends a piece."""

    def __init__(self):
        super().__init__({b"": 0, _END: 1})

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


class _Graph:
    """Edges of the texts of one language in one task, as exact packed word numbers."""

    def __init__(self):
        self.numbers, self.parts, self.size = _Numbers(), [], 0

    def add(self, words: list[bytes]) -> None:
        found = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        self.parts.append(found)
        self.size += len(found)

    def is_full(self) -> bool:
        return self.size >= WORDS_AT_ONCE or len(self.numbers) >= NUMBERS_AT_ONCE

    def flush(self, last: bool) -> tuple[np.ndarray, np.ndarray, list[bytes]] | None:
        """Distinct edges, one row of word numbers each, their weights, and the words.

        An edge that starts less than LONGEST words before the end of a piece has
        1 in place of the words that are not there. The last words wait for the
        next ones, unless these are the last.
        """
        ends = [np.ones(LONGEST, np.int64)] if last else []
        stream = np.concatenate([*self.parts, *ends]) if self.parts or last else np.zeros(0, np.int64)
        starts = max(0, len(stream) - LONGEST + 1)
        words = list(self.numbers)
        rest = stream[starts:]
        columns = [stream[k : k + starts].copy() for k in range(LONGEST)]
        for k in range(1, LONGEST):
            columns[k][columns[k - 1] == 1] = 1
        begins = columns[0] > 1
        # A part of a text adds less than NUMBERS_AT_ONCE words, so that three numbers fit 63 bits.
        bits = np.int64(int(len(words)).bit_length())
        key = np.zeros(int(begins.sum()), np.int64)
        for column in columns:
            key = (key << bits) | column[begins]
        key, weight = np.unique(key, return_counts=True)
        edges = np.stack([(key >> (bits * (LONGEST - 1 - k))) & ((1 << int(bits)) - 1) for k in range(LONGEST)])
        self.numbers = _Numbers()
        self.parts = [np.array([self.numbers[words[i]] for i in rest], np.int64)]
        self.size = len(rest)
        return edges, weight, words


def _joined(edges: np.ndarray, names: pa.Array) -> pa.Array:
    """Word numbers as texts, the words apart by one space."""
    parts = [names.take(pa.array(column)) for column in edges]
    return parts[0] if len(parts) == 1 else pc.binary_join_element_wise(*parts, " ")


def _names(words: list[bytes]) -> pa.Array:
    return pa.array([w.decode("utf-8", "replace") for w in words], pa.string())


def _graphs(documents: DataFrame, rows_of, schema: str) -> DataFrame:
    """The rows that ``rows_of(lang, edges, weight, words)`` makes of each graph of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, _Graph] = {}

        def flushed(lang: str, last: bool) -> Iterator[pa.RecordBatch]:
            for columns in rows_of(lang, *opened[lang].flush(last)):
                langs = pa.array([lang]).take(pa.array(np.zeros(len(columns[0]), np.int64)))
                yield pa.RecordBatch.from_arrays([langs, *columns], names)

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lang, value in zip(langs, batch.column("text"), strict=True):
                buffer = value.as_buffer()
                if buffer is None or not buffer.size:
                    continue
                graph = opened.setdefault(lang, _Graph())
                for words in _words(buffer.to_pybytes()):
                    graph.add(words)
                    if graph.is_full():
                        yield from flushed(lang, False)
                graph.add([_END])
                if graph.is_full() or sum(g.size for g in opened.values()) >= WORDS_AT_ONCE:
                    largest = lang if graph.is_full() else max(opened, key=lambda one: opened[one].size)
                    yield from flushed(largest, True)
                    del opened[largest]
        for lang in sorted(opened):
            yield from flushed(lang, True)

    names = [field.split()[0] for field in schema.split(", ")]
    rows = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    return rows.mapInArrow(run, schema)


def hot_nodes(documents: DataFrame, space: Workspace) -> tuple[list[tuple[str, str]], int]:
    """Nodes that would send more than one in HOT of all rows to one place, and the number of rows.

    There are fewer than HOT. Which they are has no part in the result, only in
    where it is summed.
    """

    def rows_of(lang, edges, weight, words):
        size = edges.shape[1]
        if not size:
            return
        node = edges[0] * len(words) + edges[1]
        first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        rows = np.diff(np.r_[first, size])
        many = rows > max(LEAST_HOT // 8, size // HOT)
        yield _joined(edges[:2, first[many]], _names(words)), pa.array(rows[many], pa.int64())
        yield pa.array([""]), pa.array([size], pa.int64())

    rows = _graphs(documents, rows_of, GRAMS).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rows = space.keep(rows, "hot_nodes")
    total = rows.where("gram = ''").agg(F.sum("n")).first()[0] or 0
    hot = rows.where((F.col("gram") != "") & (F.col("n") > max(LEAST_HOT, total // HOT)))
    return [tuple(r) for r in hot.select("lang", "gram").collect()], total


def local_graphs(documents: DataFrame, hot: list[tuple[str, str]], places: int) -> DataFrame:
    """``lang, place, hot, grams, counts``: the graphs of the tasks, by the place where they are summed.

    Edges have LONGEST words. Grams with fewer words, two at least, are pieces that
    end with these words. Grams of one word are the flow through that word, ends
    included, and the gram of no word is the flow through the whole graph. Grams
    are one text, one line each, and ``counts`` holds their 32-bit weights.
    """
    sent = documents.sparkSession.sparkContext.broadcast((frozenset(hot), places))

    def rows_of(lang, edges, weight, words):
        if not edges.shape[1]:
            return
        hot, places = sent.value
        names = _names(words)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        node = _mixed(hashes[edges[0]] + _mixed(hashes[edges[1]]))
        dealt = _mixed(node + _mixed(hashes[edges[-1]]))
        numbers = {word: i for i, word in enumerate(names.to_pylist())} if hot else {}
        apart = {
            numbers[u] * len(words) + numbers[v]
            for of, (u, v) in ((of, node.split(" ")) for of, node in hot)
            if of == lang and u in numbers and v in numbers
        }
        is_hot = np.isin(edges[0] * len(words) + edges[1], np.array(sorted(apart), np.int64))
        length = (edges > 1).sum(axis=0)
        flow = np.bincount(edges[0], weights=weight, minlength=len(words)).astype(np.int64)
        met = np.flatnonzero(flow)
        grams, counts = [names.take(pa.array(met)), pa.array([""])], [flow[met], [flow.sum()]]
        where, marks = [hashes[met], np.zeros(1, np.uint64)], [np.zeros(len(met) + 1, bool)]
        for n in range(LONGEST, 1, -1):
            of_it = length == n
            grams.append(_joined(edges[:n, of_it], names))
            counts.append(weight[of_it])
            marks.append(is_hot[of_it])
            where.append(np.where(is_hot, dealt, node)[of_it])
        place = (np.concatenate(where) % np.uint64(places)).astype(np.int64) * 2 + np.concatenate(marks)
        order = np.argsort(place, kind="stable")
        place = place[order]
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        ends = np.r_[first, len(place)].astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays(grams).take(pa.array(order)))
        weights = np.concatenate(counts).astype(np.int32)[order]
        yield (
            pa.array(place[first] // 2, pa.int64()),
            pa.array(place[first] % 2 == 1, pa.bool_()),
            pc.binary_join(lists, "\n"),
            pa.array([weights[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.binary()),
        )

    return _graphs(documents, rows_of, PLACED)


def _n_words(gram: Column) -> Column:
    return F.when(gram == "", F.lit(0)).otherwise(F.size(F.split(gram, " ")))


def _sums(table: pa.Table, least: int) -> pa.Table:
    """``lang, gram, n`` of one place: what occurs often enough there, and all parts of hot nodes.

    Edges, words and the whole flow are summed as they are. A node's count is the
    sum of the edges that leave it and of the pieces that end in it.
    """
    table = table.combine_chunks()
    lists = pc.split_pattern(table["grams"].combine_chunks(), "\n")
    parent = pc.list_parent_indices(lists)
    weights = np.frombuffer(b"".join(table["counts"].to_pylist()), np.int32).astype(np.int64)
    rows = pa.table({
        "lang": table["lang"].take(parent), "hot": table["hot"].take(parent),
        "gram": lists.flatten(), "n": weights,
    })
    sums = rows.group_by(["lang", "hot", "gram"]).aggregate([("n", "sum")])
    empty = pc.equal(sums["gram"], "")
    words = pc.if_else(empty, 0, pc.add(pc.count_substring(sums["gram"], " "), 1))
    whole = pc.or_(pc.equal(words, 1), pc.equal(words, LONGEST))
    often = pc.greater_equal(sums["n_sum"], least)
    kept = [sums.filter(pc.or_(empty, pc.and_(whole, often)))]
    for n in range(2, LONGEST):
        through = sums.filter(pc.greater_equal(words, n))
        node = pc.replace_substring_regex(through["gram"], rf"^((?:[^ ]+ ){{{n - 1}}}[^ ]+) .*$", r"\1")
        through = through.set_column(through.column_names.index("gram"), "gram", node)
        flow = through.select(["lang", "hot", "gram", "n_sum"]).rename_columns(["lang", "hot", "gram", "n"])
        flow = flow.group_by(["lang", "hot", "gram"]).aggregate([("n", "sum")])
        kept.append(flow.filter(pc.or_(flow["hot"], pc.greater_equal(flow["n_sum"], least))))
    columns = ["lang", "gram", "n_sum"]
    return pa.concat_tables([k.select(columns) for k in kept]).rename_columns(["lang", "gram", "n"])


def phrase_counts(documents: DataFrame, space: Workspace, least: int = LEAST) -> DataFrame:
    """``lang, gram, n`` of each phrase of up to LONGEST words that occurs ``least`` times; of no word, all.

    Places are many enough that one holds about SUMMED_AT_ONCE rows.
    """
    hot, total = hot_nodes(documents, space)
    graphs = local_graphs(documents, hot, max(64, -(-total // SUMMED_AT_ONCE)))
    small = graphs.groupBy("place").applyInArrow(lambda table: _sums(table, least), GRAMS)
    small = small.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return small.where((F.col("n") >= least) | (F.col("gram") == ""))


def _start(gram: Column) -> Column:
    return F.substring_index(gram, " ", LONGEST - 1)


def _end(gram: Column) -> Column:
    return F.substring_index(gram, " ", -(LONGEST - 1))


def _to_heads(state: DataFrame, space: Workspace, name: str, rounds: int) -> DataFrame:
    """Each edge's path and place, after as many rounds of doubling as there must be.

    ``state`` has for each edge an edge that lies ``place`` steps back in its path,
    and whether that is the first one. In a round an edge asks the edge that it has
    come to. What is not ``done`` in the end lies on a ring, and has seen all of it.
    """
    state = space.keep(state, f"{name}_0")
    for rnd in range(1, rounds + 1):
        going = state.where(~F.col("done"))
        if going.isEmpty():
            break
        asked = state.select(
            "lang",
            F.col("gram").alias("path"),
            F.col("path").alias("further"),
            F.col("place").alias("steps"),
            F.col("done").alias("ended"),
            F.col("low").alias("seen"),
        )
        moved = going.join(asked, ["lang", "path"]).select(
            "lang",
            "gram",
            "n",
            F.col("further").alias("path"),
            (F.col("place") + F.col("steps")).alias("place"),
            F.col("ended").alias("done"),
            F.least("low", "seen").alias("low"),
        )
        state = space.keep(state.where("done").unionByName(moved), f"{name}_{rnd}")
        space.drop(f"{name}_{rnd - 1}")
    return state


def _linked(rows: DataFrame, before: DataFrame) -> DataFrame:
    """The edges with the edge ``before`` them in their path, or with themselves if it begins there."""
    rows = rows.select("lang", "gram", "n").join(before, ["lang", "gram"], "left")
    first = F.col("before").isNull()
    return rows.select(
        "lang",
        "gram",
        "n",
        F.coalesce("before", "gram").alias("path"),
        F.when(first, 0).otherwise(1).cast("long").alias("place"),
        first.alias("done"),
        F.least("gram", F.coalesce("before", "gram")).alias("low"),
    )


def compact_paths(edges: DataFrame, space: Workspace) -> DataFrame:
    """``lang, gram, n, path, place``: every edge's unary path and its place there, from 0.

    A path goes on through a node with one edge in and one edge out. It is named
    by its first edge; a ring of such nodes begins with its least edge. Edges learn
    their path by doubling, so that a path of any length takes as many rounds as the
    logarithm of its length, and no path is gathered in one place.
    """
    rows = edges.select("lang", "gram", "n")
    gram = F.col("gram")
    into = rows.groupBy("lang", _end(gram).alias("node")).agg(
        F.count(F.lit(1)).alias("ins"), F.min("gram").alias("before")
    )
    out = rows.groupBy("lang", _start(gram).alias("node")).agg(
        F.count(F.lit(1)).alias("outs"), F.min("gram").alias("gram")
    )
    inner = into.join(out, ["lang", "node"]).where("ins = 1 and outs = 1")
    inner = space.keep(inner.select("lang", "gram", "before"), "inner")
    rounds = int(rows.count()).bit_length() + 1
    state = _to_heads(_linked(rows, inner), space, "paths", rounds)
    columns = ["lang", "gram", "n", "path", "place"]
    ring = state.where(~F.col("done"))
    if ring.isEmpty():
        return state.select(*columns)
    # A ring is cut before its least edge, which all its edges have seen.
    cut = ring.where(F.col("low") != gram).select("lang", "gram")
    opened = _linked(ring, inner.join(cut, ["lang", "gram"], "left_semi"))
    opened = _to_heads(opened, space, "rings", rounds)
    return state.where("done").select(*columns).unionByName(opened.select(*columns))


def maximal_phrases(paths: DataFrame) -> DataFrame:
    """``lang, path, phrase, n_edges, least, most``: each unary path as one text, with its weights."""
    order = F.sort_array(F.collect_list(F.struct("place", "gram")))
    rows = paths.groupBy("lang", "path").agg(
        order.alias("grams"), F.count(F.lit(1)).alias("n_edges"), F.min("n").alias("least"), F.max("n").alias("most")
    )
    tail = F.expr("transform(slice(grams, 2, size(grams)), g -> substring_index(g.gram, ' ', -1))")
    phrase = F.concat_ws(" ", F.array(F.col("grams")[0]["gram"]), tail)
    return rows.select("lang", "path", phrase.alias("phrase"), "n_edges", "least", "most")


def covering_counts(paths: DataFrame) -> DataFrame:
    """``lang, gram, longer``: for each node the weight of the heaviest edge into or out of it.

    Inside a path the edge after a node is the next one in the path. Only the nodes
    at a path's ends may have several, and are summed up over the paths.
    """
    following = paths.select("lang", "path", (F.col("place") - 1).alias("place"), F.col("n").alias("after"))
    rows = paths.join(following, ["lang", "path", "place"], "left")
    inside = rows.where("after is not null").select(
        "lang", _end(F.col("gram")).alias("gram"), F.greatest("n", "after").alias("longer")
    )
    starts = rows.where("place = 0").select("lang", _start(F.col("gram")).alias("gram"), F.col("n").alias("longer"))
    ends = rows.where("after is null").select("lang", _end(F.col("gram")).alias("gram"), F.col("n").alias("longer"))
    at_ends = starts.unionByName(ends).groupBy("lang", "gram").agg(F.max("longer").alias("longer"))
    return inside.unionByName(at_ends)


def _cuts(candidates: DataFrame) -> DataFrame:
    """``lang, gram, n, k, side, part``: each way to cut a phrase in two, one row a side."""
    ways = []
    for k in range(1, LONGEST):
        fits = candidates.where(_n_words(F.col("gram")) > k)
        rest = F.expr(f"substr(gram, length(substring_index(gram, ' ', {k})) + 2)")
        for side, part in (("l", F.substring_index("gram", " ", k)), ("r", rest)):
            ways.append(fits.select("lang", "gram", "n", F.lit(k).alias("k"), F.lit(side).alias("side"), part.alias("part")))
    return union_all(ways)


def weakest_cuts(cuts: DataFrame) -> DataFrame:
    """``lang, phrase, a, l, r, score`` of each phrase's weakest cut, the first of equal ones.

    ``cuts`` has ``lang, gram, n, k, l, r``. Products have up to 38 digits.
    """
    big = {c: F.col(c).cast("decimal(19,0)") for c in ("n", "l", "r")}
    million = F.lit(1_000_000).cast("decimal(7,0)")
    cuts = cuts.withColumn("over", million * big["n"] * big["n"]).withColumn("under", big["l"] * big["r"])
    scored = cuts.withColumn("score", F.expr("over div under"))
    best = scored.groupBy("lang", "gram", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select(
        "lang",
        F.col("gram").alias("phrase"),
        F.col("n").alias("a"),
        F.col("cut.l").alias("l"),
        F.col("cut.r").alias("r"),
        F.col("cut.score").alias("score"),
    )


def _first(rows: DataFrame, most: int) -> DataFrame:
    """The first ``most`` rows of each language, with their ``rank``.

    Rows are dealt out and cut in each share until a language's rest fits a task.
    """
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    shares = -(-rows.count() // RANKED_AT_ONCE)
    while shares > 1:
        dealt = rows.withColumn("_share", F.pmod(F.xxhash64("phrase"), F.lit(shares)))
        place = F.row_number().over(Window.partitionBy("lang", "_share").orderBy(*order))
        rows = dealt.withColumn("_place", place).where(F.col("_place") <= most).drop("_share", "_place")
        shares = 1 if shares * most <= RANKED_AT_ONCE else -(-shares * most // RANKED_AT_ONCE)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return rows.withColumn("rank", place.cast("long")).where(F.col("rank") <= most)


def collocations(documents: DataFrame, most: int = 2000, least: int = LEAST) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of two to LONGEST words.

    ``documents`` has ``text, lang``. ``a`` is how often the phrase occurs inside
    pieces, ``l`` and ``r`` how often the two parts do at its weakest cut, ``n`` all
    words of the language, ``score`` a million times a a / (l r), rounded down; it is
    worked out in decimals of 38 digits. Phrases that are mostly part of a longer
    one are left out.

    A null or empty text has no words. A null language is ``und``; an empty one is a
    language. Rows are texts of their own, also when they are repeated. A very long
    text is split in parts that keep its order. Equal scores are ranked by ``a``,
    then by the bytes of the phrase. Other columns are not read. No rows give none.
    """
    space = Workspace(documents.sparkSession)
    counts = space.keep(phrase_counts(documents, space, least), "counts")
    size = _n_words(F.col("gram"))
    paths = space.keep(compact_paths(counts.where(size == LONGEST), space), "paths")
    space.drop_all_but("counts", "paths")
    covered = covering_counts(paths)
    phrases = counts.where(size >= 2).join(covered, ["lang", "gram"], "left")
    longer = F.coalesce(F.col("longer"), F.lit(0))
    candidates = space.keep(
        phrases.where(100 * longer < COVERED * F.col("n")).select("lang", "gram", "n"), "candidates"
    )
    cuts = space.keep(_cuts(candidates), "cuts")
    known = counts.select("lang", F.col("gram").alias("part"), F.col("n").alias("of_part"))
    sides = spread_join(cuts, known, ["lang", "part"], "gram")

    def of_side(side: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col("of_part")))

    whole = sides.groupBy("lang", "gram", "n", "k").agg(of_side("l").alias("l"), of_side("r").alias("r"))
    total = counts.where("gram = ''").select("lang", "n")
    rows = weakest_cuts(whole)
    ranked = space.keep(_first(space.keep(rows, "scored"), most), "ranked")
    result = space.keep(
        ranked.join(total, "lang").select(
            "lang", "rank", "phrase", "a", "l", "r", "n", "score"
        ),
        "collocations",
    )
    space.drop_all_but("collocations")
    return result
