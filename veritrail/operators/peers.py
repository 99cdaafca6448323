"""Each submission against other students' submissions of its subject, with weights fitted for it alone.

The corpus of a target is the target and what other students handed in: the student's own other submissions count for nothing. Nothing is
fitted once for each target, though; counts are taken once a subject and corrected.

- Without a student's own submissions, a term's counts fall by the student's share; a target's own counts come back on top of that. No count exceeds the
  subject's, so that a vocabulary comes from the subject's most frequent terms alone, as many as let every student keep a cap of them that still come
  before all others: that is checked, and more are taken until it holds.
- The length of a peer under a target's fit is a sum over its terms. Logarithms of document counts shift by one number for all terms but the student's,
  so that three sums a peer give it; terms of the student, of the target, and those that the target's push out are corrected where peers have them.
- Products and corrections are taken for two blocks of documents at a time, and a target's greatest cosine and its matches leave the task: no pair is moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritrail.functions.text import stripped
from veritrail.operators.similarity import Block, both, counted, dealt, packed, pieces, places, unpacked
from veritrail.sources.catalog import materialise

#: The cap of a vocabulary, the similarity of a match, and the least length of a text that is compared.
TERMS, MATCH, LEAST_LENGTH = 5000, 0.15, 20
#: Documents of a block at most, targets and peers of a tile, cells of a matrix, targets that are summed up at a time, and the share of peers from which a term is a matrix's.
BLOCK, TARGETS, PEERS, CELLS, STEP, OFTEN = 1 << 14, 1024, 4096, 1 << 22, 8, 0.05
#: A cosine above this is more than MATCH once it is rounded to nine places.
ABOVE = MATCH + 5e-10


def _fitted(corpus: DataFrame, cap: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What `counted` gives of the corpus, for terms enough, and (subject, owner, m, terms, totals, dfs): each student's texts, and how often and in how
    many of them the student has these terms.

    A term below the list has no more than the last one's count, less nothing or a share; a student keeps at least `cap` terms of the list before all of
    them, or the list is made longer. Students without peers need none.
    """
    most = 2 * cap
    m = corpus.groupBy("subject", "owner").agg(F.count("*").alias("m"))
    while True:
        bags, known = counted(corpus, "subject", "id", "text", True, most, "owner")
        entries = bags.select("subject", "owner", F.explode(F.arrays_zip("terms", "counts")).alias("x")).select("subject", "owner", F.col("x.terms").alias("rank"), F.col("x.counts").alias("tf"))
        own = materialise(entries.groupBy("subject", "owner", "rank").agg(F.sum("tf").alias("own"), F.count("*").alias("own_df")), "own")
        last = known.where(F.col("rank") == most - 1).select("subject", F.col("total").alias("last_total"), F.col("term").alias("last_term"), "n")
        left = own.join(known.select("subject", "rank", "term", "total"), ["subject", "rank"]).join(F.broadcast(last), "subject").withColumn("left", F.col("total") - F.col("own"))
        behind = (F.col("left") < F.col("last_total")) | ((F.col("left") == F.col("last_total")) & (F.col("term") > F.col("last_term")))
        lost = left.where(behind).groupBy("subject", "owner", "n").agg(F.count("*").alias("lost")).join(m, ["subject", "owner"]).where("m < n").agg(F.max("lost")).first()[0]
        if (lost or 0) <= most - cap:
            break
        most *= 4
    of = F.array_sort(F.collect_list(F.struct("rank", "own", "own_df")))
    listed = own.groupBy("subject", "owner").agg(of.alias("xs")).join(m, ["subject", "owner"])
    return bags, known, listed.select("subject", "owner", "m", F.col("xs.rank").alias("terms"), F.col("xs.own").alias("totals"), F.col("xs.own_df").alias("dfs"))


class _Subject:
    """A subject's texts and terms: how often a term occurs, in how many texts, its place by name, and its weight where the subject's own vocabulary has it."""

    def __init__(self, data: bytes, cap: int) -> None:
        numbers = np.frombuffer(data, dtype=np.int64)
        self.cap, self.n, (self.total, self.df, self.name) = cap, int(numbers[0]), numbers[1:].reshape(3, -1)
        self.known = np.arange(len(self.total)) < cap
        self.idf = np.where(self.known, np.log((1 + self.n) / (1 + self.df)) + 1, 0.0)

    def keys(self, total: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
        """Numbers in the order of a vocabulary, the greatest first: by total, of equals the first by name."""
        return total * len(self.name) + (len(self.name) - 1 - self.name[at])


class _Student:
    """A vocabulary and its squared weights without a student's own texts, and where these differ from the subject's."""

    def __init__(self, subject: _Subject, m: int, terms: np.ndarray, totals: np.ndarray, dfs: np.ndarray) -> None:
        self.subject, self.n = subject, subject.n - m + 1
        self.total, self.df = subject.total.copy(), subject.df.copy()
        self.total[terms] -= totals
        self.df[terms] -= dfs
        self.key = np.where(self.df > 0, subject.keys(self.total, slice(None)), -1)
        over = len(self.key) - subject.cap
        self.held = self.key >= (max(np.partition(self.key, over)[over], 0) if over > 0 else 0)
        self.weight = np.where(self.held, (np.log((1 + self.n) / (1 + self.df)) + 1) ** 2, 0.0)
        self.shift = np.log((1 + self.n) / (1 + subject.n))
        come = self.held & ~subject.known
        come[terms] = True
        self.changed = np.flatnonzero(come)
        self.change = self.weight[self.changed] - np.where(subject.known, subject.idf + self.shift, 0.0)[self.changed] ** 2

    def target(self, terms: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(terms, weights, changes): squared weights of the target's terms, and what they and the terms that they push out change in the student's."""
        held = self.held.copy()
        held[terms] = False
        others = np.flatnonzero(held)
        theirs, mine = self.key[others], self.subject.keys(self.total[terms] + tf, terms)
        over = len(others) + len(terms) - self.subject.cap
        least = np.partition(np.concatenate([theirs, mine]), over)[over] if over > 0 else 0
        weight = np.where(mine >= least, (np.log((1 + self.n) / (2 + self.df[terms])) + 1) ** 2, 0.0)
        pushed = others[theirs < least]
        return np.concatenate([terms, pushed]), np.concatenate([weight, np.zeros(len(pushed))]), np.concatenate([weight - self.weight[terms], -self.weight[pushed]])


class _Entries:
    """Entries of a matrix by rows: n rows, and for each entry its row, its term and values."""

    def __init__(self, parts: list[tuple[np.ndarray, ...]]) -> None:
        self.n = len(parts)
        self.row = np.repeat(np.arange(self.n), [len(p[0]) for p in parts])
        self.term, *self.values = (np.concatenate(x) for x in zip(*parts, strict=True))


class _Tile:
    """Peers by term: who has it, and how often."""

    def __init__(self, block: Block, tile: tuple[int, int], terms: int) -> None:
        at = slice(block.begin[tile[0]], block.begin[tile[1]])
        order = np.argsort(block.term[at], kind="stable")
        self.at, self.n = slice(*tile), tile[1] - tile[0]
        self.peer, self.tf = (block.row[at][order] - tile[0]).astype(np.int32), block.x[at][order]
        self.held = np.bincount(block.term[at], minlength=terms)
        self.begin = np.cumsum(self.held) - self.held

    def products(self, rows: _Entries, powers: tuple[int, ...]) -> list[np.ndarray]:
        """For each of the values and powers a matrix: for rows and peers, sums of value x count ** power. Terms that many peers have are multiplied as matrices, others summed up along those that have them."""
        often = np.flatnonzero(self.held > OFTEN * self.n)
        place = np.full(len(self.held), -1)
        place[often] = np.arange(len(often))
        out, width = [np.zeros((rows.n, self.n)) for _ in powers], max(CELLS // max(self.n, rows.n), 1)
        of = place[rows.term]
        for k in range(0, len(often), width):
            # terms of this part of the matrix, and what rows and peers have of them
            some = often[k : k + width]
            size = self.held[some]
            entry = np.repeat(self.begin[some] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            here = (of >= k) & (of < k + width)
            for o, value, power in zip(out, rows.values, powers, strict=True):
                left, right = np.zeros((rows.n, len(some))), np.zeros((len(some), self.n))
                left[rows.row[here], of[here] - k] = value[here]
                right[np.repeat(np.arange(len(some)), size), self.peer[entry]] = self.tf[entry] ** power
                o += left @ right
        rare = np.flatnonzero((of < 0) & (self.held[rows.term] > 0))
        row, term, count = rows.row[rare], rows.term[rare], self.held[rows.term[rare]]
        bounds = np.searchsorted(row, np.arange(0, rows.n + STEP, STEP))
        for k, (i, j) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            c, first, m = count[i:j], k * STEP, min(STEP, rows.n - k * STEP)
            if not len(c):
                continue
            entry = np.repeat(self.begin[term[i:j]] - (np.cumsum(c) - c), c) + np.arange(c.sum())
            cell = np.repeat((row[i:j] - first) * self.n, c) + self.peer[entry]
            tf = self.tf[entry]
            for o, value, power in zip(out, rows.values, powers, strict=True):
                sums = np.bincount(cell, np.repeat(value[rare[i:j]], c) * tf**power, minlength=m * self.n)
                o[first : first + m] += sums.reshape(m, self.n)
        return out


def _best(subject: _Subject, students: dict, a: Block, b: Block, tiles: list[_Tile]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, greatest cosines, matches) of the targets `a` among the peers `b`, a tile of targets at a time."""
    square, idf, known = b.x * b.x, subject.idf[b.term], subject.known[b.term]
    plain = [np.bincount(b.row, square * w, minlength=len(b.id)) for w in (idf * idf, idf, known)]
    for start, end in a.tiles(TARGETS):
        targets, fits, which = [], [], []
        own = np.zeros(end - start)
        for i in range(start, end):
            if i == start or a.owner[i] != a.owner[i - 1]:
                fits.append(_Student(subject, *students[a.owner[i]]))
            at = slice(a.begin[i], a.begin[i + 1])
            terms, tf = a.term[at], a.x[at]
            every, weight, change = fits[-1].target(terms, tf.astype(np.int64))
            own[i - start] = (tf * tf * weight[: len(terms)]).sum()
            targets.append((every, weight * np.concatenate([tf, np.zeros(len(every) - len(terms))]), change))
            which.append(len(fits) - 1)
        rows, changes = _Entries(targets), _Entries([(s.changed, s.change) for s in fits])
        shift = np.array([s.shift for s in fits])[:, None]
        most, matches = np.zeros(end - start), np.zeros(end - start, dtype=np.int64)
        for tile in tiles:
            dot, change = tile.products(rows, (1, 2))
            length = tile.products(changes, (2,))[0]
            length += plain[0][tile.at] + 2 * shift * plain[1][tile.at] + shift * shift * plain[2][tile.at]
            change += length[which]
            change *= own[:, None]
            dot[a.owner[start:end, None] == b.owner[None, tile.at]] = 0
            # a peer without common terms may have no length at all
            dot *= dot
            np.divide(dot, change, out=dot, where=dot > 0)
            most = np.maximum(most, dot.max(axis=1))
            matches += (dot > ABOVE * ABOVE).sum(axis=1)
        yield a.id[start:end], np.sqrt(most), matches


def _students(data: list[bytes]) -> dict:
    """{student: (texts, terms, totals, document counts)} of packed rows."""
    table = unpacked(data)
    begin, terms = places(table.column("terms").combine_chunks())
    totals, dfs = (table.column(c).combine_chunks().flatten().to_numpy() for c in ("totals", "dfs"))
    ends = zip(begin[:-1], begin[1:], strict=True)
    return {o: (m, terms[i:j], totals[i:j], dfs[i:j]) for o, m, (i, j) in zip(table.column("owner").to_numpy(), table.column("m").to_pylist(), ends, strict=True)}


def _as_data(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The numbers of a subject for each pair of blocks, as side -1."""
    for batch in batches:
        lists = (batch.column(c).to_pylist() for c in ("totals", "dfs", "names"))
        data = [np.array([n, *total, *df, *name], dtype=np.int64).tobytes() for n, total, df, name in zip(batch.column("n").to_pylist(), *lists, strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("subject", "i", "j")), pa.array([-1] * len(data), pa.int32()), pa.array(data, pa.binary())], names=["subject", "i", "j", "side", "data"])


def _met(bags: DataFrame, known: DataFrame, students: DataFrame, cap: int, block: int) -> DataFrame:
    """(id, most, matches) of targets for each block of peers; documents are dealt into blocks, of which two at a time meet in a task, in both directions."""
    kind = dict(bags.dtypes)
    parts = pieces(F.col("n"), block)
    blocks = bags.withColumn("block", F.pmod(F.xxhash64("id"), parts).cast("int"))
    sizes = bags.groupBy("subject").agg(F.max(parts).alias("pieces"))
    there = blocks.select("subject", "owner", "block").distinct().join(students, ["subject", "owner"])
    docs = packed(blocks.select("subject", "block", "id", "owner", "terms", F.col("counts").alias("values")))
    fits = packed(there.select("subject", "block", "owner", "m", "terms", "totals", "dfs"))
    named = known.withColumn("name", F.row_number().over(Window.partitionBy("subject").orderBy("term")) - 1)
    listed = named.groupBy("subject", "n").agg(F.array_sort(F.collect_list(F.struct("rank", "total", "df", "name"))).alias("xs"))
    heads = both(sizes.join(listed.select("subject", "n", F.col("xs.total").alias("totals"), F.col("xs.df").alias("dfs"), F.col("xs.name").alias("names")), "subject"))
    head = heads.mapInArrow(_as_data, f"subject {kind['subject']}, i int, j int, side int, data binary")
    dealt_out = dealt(docs, sizes).unionByName(dealt(fits, sizes, 2)).unionByName(head)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[int, list[bytes]] = {side: [] for side in range(-1, 4)}
        for batch in batches:
            for side, data in zip(batch.column("side").to_pylist(), batch.column("data").to_pylist(), strict=True):
                of[side].append(data)
        same = key[1].as_py() == key[2].as_py()
        if not of[0] or not (same or of[1]):
            return
        subject = _Subject(of[-1][0], cap)
        a, b = Block(of[0], None), None if same else Block(of[1], None)
        for x, y, fit in [(a, a, 2)] if same else [(a, b, 2), (b, a, 3)]:
            tiles = [_Tile(y, t, len(subject.total)) for t in y.tiles(PEERS)]
            for ids, most, matches in _best(subject, _students(of[fit]), x, y, tiles):
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(most), pa.array(matches)], names=["id", "most", "matches"])

    return dealt_out.groupBy("subject", "i", "j").applyInArrow(run, f"id {kind['id']}, most double, matches long")


def scores(docs: DataFrame, subject: str, id: str, student: str, text: str, cap: int = TERMS, block: int = BLOCK, least: int = LEAST_LENGTH) -> DataFrame:
    """Each document's highest similarity, in percent, to other students' documents of its subject, and how many of them match; 0 for texts of less than
    `least` characters and without peers."""
    named = docs.select(F.col(subject).alias("subject"), F.col(id).alias("id"), F.col(student).alias("owner"), F.col(text).alias("text"))
    corpus = named.where("text <> '' and subject is not null and owner is not null")
    bags, known, students = _fitted(corpus, cap)
    best = _met(bags, known, students, cap, block).groupBy("id").agg(F.max("most").alias("most"), F.sum("matches").alias("matches"))
    compared = F.coalesce(F.length(stripped(F.col("text"))) >= least, F.lit(False))
    found = named.select("id", compared.alias("compared")).join(best, "id", "left")
    most, matches = (F.when(F.col("compared"), F.coalesce(c, F.lit(0))).otherwise(F.lit(0)) for c in ("most", "matches"))
    return found.select(F.col("id").alias(id), F.round(100 * most, 2).alias("similarity_score"), F.round(most, 4).alias("max_similarity"), matches.alias("matches"))
