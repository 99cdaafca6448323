"""TF-IDF cosine similarity inside subjects.

Weights follow the usual library's defaults: words of two characters and more, stop words out before bigrams are formed, raw counts,
idf = ln((1 + n) / (1 + df)) + 1, rows of length 1; the cap keeps the terms that occur most often, of equals the first in order.

Pairs above a similarity are found by products of matrices of two blocks of documents at a time, whose links leave the task as they are found; what is
asked of owners is taken together in the task. `candidates` is an inverted index whose lists hold only entries that may still matter: for texts that
share few words it forms few pairs, but those it forms are shuffled.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrail.functions import fixed
from veritrail.functions.text import BETWEEN, let, words
from veritrail.sources.catalog import materialise, remove, written

#: The cap of the vocabulary and the similarity of an edge.
PAIR_TERMS = 2500
EDGE = 0.30
LEAST_LENGTH = 5
#: Entries of a term that one task still meets with all others, and in how many parts a vocabulary is cut to its most frequent terms first.
HOT, PARTS = 1 << 14, 32
#: Blocks of a subject that two at a time meet in a task, the fewest and the most documents of one, sides and cells of the matrices, rows of a batch, and terms that go to all tasks.
PIECES, SMALL, BLOCK = 6, 2048, 1 << 16
TILE, CELLS, ROWS, KNOWN = 1024, 1 << 23, 1 << 17, 1 << 21
#: Partitions of pairs of blocks at most.
SHARES = 4096
#: Documents whose words are numbered together, what ends a row of a document of several, and what words are numbers to.
DOCS, END, BASE = 4096, "\0", 0x100000001B3
#: The share of a tile's pairs that have a term in common from which it is a matrix's, products that are summed up at a time, and documents of owners that are multiplied together.
OFTEN, SUMS, GROUP = 0.006, 1 << 17, 128
#: What sums of rounded numbers may be off by.
SLACK = 1e-9


def term_counts(docs: DataFrame, keys: list[str], text: str, bigrams: bool, stop: tuple[str, ...] = fixed.STOP_WORDS) -> DataFrame:
    """(*keys, term, tf): the words of each text, in lower case, of two characters and more and not in `stop`, and pairs of such that follow each other."""
    token = F.filter(words(F.lower(text)), lambda w: (F.length(w) >= 2) & ~w.isin(*stop))

    def with_bigrams(t):
        pairs = F.transform(F.sequence(F.lit(1), F.size(t) - 1), lambda i: F.concat_ws(" ", F.element_at(t, i), F.element_at(t, i + 1)))
        return F.when(F.size(t) > 1, F.concat(t, pairs)).otherwise(t)

    terms = let(token, with_bigrams) if bigrams else token
    return docs.select(*keys, F.explode(terms).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def counted(docs: DataFrame, subject: str, id: str, text: str, bigrams: bool, cap: int, owner: str | None = None, stop: tuple[str, ...] = fixed.STOP_WORDS) -> tuple[DataFrame, DataFrame]:
    """((subject, id, owner, n, terms, counts), (subject, term, rank, idf)): the terms that a document has of its subject's vocabulary, by their places there,
    how often it has them, and n documents of the subject; and these vocabularies, with total, df and n. Both are written tables.

    Texts are dealt out and cut into words once; what is kept of them are numbers of words, a batch at a time, and each batch's own list of words, so that terms
    are counted as numbers. The vocabularies go to all tasks, unless they have more than KNOWN terms in all: then rows of terms meet them.
    """
    part = F.pmod(F.xxhash64(id), F.lit(PARTS)).cast("int")
    docs = docs.select(F.col(subject).alias("subject"), F.col(id).alias("id"), (F.col(owner) if owner else F.lit(0)).alias("owner"), F.col(text).alias("text"), part.alias("part")).where("subject is not null")
    same = docs.groupBy("subject", "id", "owner").agg(F.count("*").alias("n"))
    size = materialise(same.groupBy("subject").agg(F.sum("n").alias("n"), F.max("n").alias("most")), "sizes")
    listed = docs.repartition("subject", "part").select("subject", "id", "owner", F.regexp_replace(F.lower("text"), BETWEEN, "\n").alias("line"))
    if (size.agg(F.max("most")).first()[0] or 0) > 1:
        # rows of one document count as one, but no bigram is formed across them
        listed = listed.groupBy("subject", "id", "owner").agg(F.array_join(F.collect_list("line"), f"\n{END}\n").alias("line"))
    kind = dict(listed.dtypes)
    numbered, at = written(listed.mapInArrow(lambda batches: _numbered(batches, stop), "docs binary, words binary, codes binary"), "tokens")
    # totals move once, by parts of the vocabulary, and each part's most frequent terms are taken first
    few = _most_frequent(numbered.mapInArrow(lambda batches: _totals(batches, bigrams), f"subject {kind['subject']}, part int, data binary"), cap)
    most = [F.desc("total"), F.col("term")]
    known = few.withColumn("rank", F.row_number().over(Window.partitionBy("subject").orderBy(*most))).where(F.col("rank") <= cap)
    known = materialise(known.join(size, "subject").select("subject", "term", (F.col("rank") - 1).alias("rank"), (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"), "total", "df", "n"), "vocabulary")
    schema = f"subject {kind['subject']}, id {kind['id']}, owner {kind['owner']}, n long, terms array<int>, counts array<int>"
    if known.count() <= KNOWN:
        table = known.select("subject", "rank", "term", "n").toArrow().sort_by("rank")
        held: dict = {}
        for x, i in table.select(["subject"]).to_pandas().groupby("subject", sort=False).indices.items():
            held[x] = (table.column("n")[int(i[0])].as_py(), table.column("term").take(pa.array(i)).combine_chunks())
        vocabulary = docs.sparkSession.sparkContext.broadcast(held)
        bags = materialise(numbered.mapInArrow(lambda batches: _bags(batches, bigrams, vocabulary.value), schema), "counts")
        vocabulary.destroy()
    else:
        tf = term_counts(docs.repartition("subject", "part"), ["subject", "part", "id", "owner"], "text", bigrams, stop)
        of = F.array_sort(F.collect_list(F.struct("rank", F.col("tf").cast("int").alias("tf"))))
        met_ = tf.join(known.select("subject", "term", "rank", "n"), ["subject", "term"]).groupBy("subject", "part", "id", "owner").agg(F.max("n").alias("n"), of.alias("xs"))
        bags = materialise(met_.select("subject", "id", "owner", "n", F.transform("xs", lambda x: x["rank"]).alias("terms"), F.transform("xs", lambda x: x["tf"]).alias("counts")), "counts")
    remove(docs.sparkSession, at)
    return bags, known


def _stream(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return out.getvalue().to_pybytes()


def _numbered(batches: Iterator[pa.RecordBatch], stop: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Words of (subject, id, owner, line) as numbers, DOCS documents a row: these with how many words they have, the words, and the words' places among these."""
    for every in batches:
        for k in range(0, len(every), DOCS):
            batch = every.slice(k, DOCS)
            split = pc.split_pattern(pc.fill_null(batch.column("line"), ""), "\n")
            doc = np.repeat(np.arange(len(batch)), pc.list_value_length(split).to_numpy())
            flat = split.flatten().dictionary_encode()
            code, word = flat.indices.to_numpy(), flat.dictionary
            plain = pc.and_(pc.greater_equal(pc.utf8_length(word), 2), pc.invert(pc.is_in(word, value_set=pa.array(stop, pa.string()))))
            kept = pc.or_(plain, pc.equal(word, END)).to_numpy(zero_copy_only=False)
            size = np.bincount(doc[kept[code]], minlength=len(batch)).astype(np.int32)
            docs = pa.table([*(batch.column(c) for c in ("subject", "id", "owner")), pa.array(size)], names=["subject", "id", "owner", "size"])
            codes = (np.cumsum(kept) - 1)[code[kept[code]]].astype(np.int32)
            data = (docs, pa.table([word.filter(pa.array(kept))], names=["word"]), pa.table([pa.array(codes)], names=["code"]))
            yield pa.RecordBatch.from_arrays([pa.array([_stream(x)], pa.binary()) for x in data], names=["docs", "words", "codes"])


def _terms(batches: Iterator[pa.RecordBatch], bigrams: bool) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray, Callable]]:
    """What `_numbered` has made, with terms: (documents, subjects, where documents have terms, which, how often, names of terms)."""
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            docs, words_, codes = (pa.ipc.open_stream(x).read_all().combine_chunks() for x in row)
            word = pa.concat_arrays(words_.column("word").chunks) if len(words_) else pa.array([], pa.string())
            code = codes.column("code").to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(len(docs)), docs.column("size").to_numpy())
            one = code != pc.index(word, END).as_py()
            pair = np.zeros(0, dtype=np.int64)
            keys = [(doc[one], code[one])]
            if bigrams and len(code):
                both_ = np.flatnonzero((doc[1:] == doc[:-1]) & one[1:] & one[:-1])
                pair, which = np.unique(code[both_] * len(word) + code[both_ + 1], return_inverse=True)
                keys.append((doc[both_], len(word) + which))
            n = len(word) + len(pair)
            entry, tf = np.unique(np.concatenate([d * n + t for d, t in keys]), return_counts=True)

            def names(at: np.ndarray, word=word, pair=pair) -> pa.Array:
                first = int(np.searchsorted(at, len(word)))
                two = pair[at[first:] - len(word)]
                joined = pc.binary_join_element_wise(word.take(pa.array(two // max(len(word), 1))), word.take(pa.array(two % max(len(word), 1))), " ")
                return pa.concat_arrays([word.take(pa.array(at[:first])), joined])

            yield docs, docs.column("subject").combine_chunks().dictionary_encode(), entry // max(n, 1), entry % max(n, 1), tf, names


def _totals(batches: Iterator[pa.RecordBatch], bigrams: bool) -> Iterator[pa.RecordBatch]:
    """(subject, part, data) of each row of `_numbered`: terms, totals and dfs, as compressed Arrow, by parts of the vocabulary."""
    for _, subject, doc, term, tf, names in _terms(batches, bigrams):
        of = subject.indices.to_numpy()[doc]
        for s in range(len(subject.dictionary)):
            at, which = np.unique(term[of == s], return_inverse=True)
            total, df = np.bincount(which, tf[of == s], minlength=len(at)).astype(np.int64), np.bincount(which, minlength=len(at))
            table = pa.table([names(at), pa.array(total), pa.array(df)], names=["term", "total", "df"])
            part = _parts(table.column("term").combine_chunks())
            order = np.argsort(part, kind="stable")
            table, ends = table.take(pa.array(order)), [*_runs(part[order]), len(order)] if len(order) else [0]
            parts = [(part[order[i]], _stream(table.slice(i, j - i))) for i, j in zip(ends[:-1], ends[1:], strict=True)]
            if parts:
                columns = [pa.array([p for p, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.repeat(subject.dictionary[s], len(parts)), *columns], names=["subject", "part", "data"])


def _parts(words_: pa.StringArray) -> np.ndarray:
    """Into which of PARTS parts words fall: their bytes as the digits of a number, by sums over all of them, each less what was there before it."""
    if not len(words_):
        return np.zeros(0, dtype=np.int64)
    begin = np.frombuffer(words_.buffers()[1], np.int32)[words_.offset : words_.offset + len(words_) + 1].astype(np.int64)
    digit = np.frombuffer(words_.buffers()[2] or b"", np.uint8)[begin[0] : begin[-1]].astype(np.uint64)
    power = lambda base: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(digit), base, np.uint64)]))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(digit * power(BASE)[:-1])])
    begin -= begin[0]
    number = (sums[begin[1:]] - sums[begin[:-1]]) * power(pow(BASE, -1, 1 << 64))[begin[:-1]]
    mixed = (number ^ (number >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(PARTS)).astype(np.int64)


def _bags(batches: Iterator[pa.RecordBatch], bigrams: bool, known: dict) -> Iterator[pa.RecordBatch]:
    """(subject, id, owner, n, terms, counts) of documents by `known`, {subject: (n, terms by rank)}; a document without known terms has no row."""
    for docs, subject, doc, term, tf, names in _terms(batches, bigrams):
        of, n = subject.indices.to_numpy(), np.zeros(len(docs), dtype=np.int64)
        rank = np.full(len(doc), -1)
        for s, x in enumerate(subject.dictionary.to_pylist()):
            if x in known:
                n[of == s], terms = known[x]
                mine = np.flatnonzero(of[doc] == s)
                at, which = np.unique(term[mine], return_inverse=True)
                rank[mine] = pc.fill_null(pc.index_in(names(at), value_set=terms), -1).to_numpy(zero_copy_only=False)[which]
        kept = np.flatnonzero(rank >= 0)
        kept = kept[np.lexsort((rank[kept], doc[kept]))]
        there, size = np.unique(doc[kept], return_counts=True)
        offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x[kept].astype(np.int32))) for x in (rank, tf)]
        own = [docs.column(c).combine_chunks().take(pa.array(there)) for c in ("subject", "id", "owner")]
        yield pa.RecordBatch.from_arrays([*own, pa.array(n[there]), *lists], names=["subject", "id", "owner", "n", "terms", "counts"])


def _most_frequent(moved: DataFrame, cap: int) -> DataFrame:
    """(subject, term, total, df): the `cap` most frequent terms of each part of a vocabulary, of what `_totals` gives."""
    kind = dict(moved.dtypes)

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = [x for batch in batches for x in batch.column("data").to_pylist()]
        summed = unpacked(data).group_by("term").aggregate([("total", "sum"), ("df", "sum")])
        total = summed.column("total_sum").to_numpy()
        if len(total) > cap:
            summed = summed.filter(pa.array(total >= np.partition(total, len(total) - cap)[len(total) - cap]))
        first = summed.sort_by([("total_sum", "descending"), ("term", "ascending")]).slice(0, cap).combine_chunks()
        for batch in first.select(["term", "total_sum", "df_sum"]).to_batches(ROWS):
            yield pa.RecordBatch.from_arrays([pa.repeat(key[0], len(batch)), *batch.columns], names=["subject", "term", "total", "df"])

    return moved.groupBy("subject", "part").applyInArrow(merge, f"subject {kind['subject']}, term string, total long, df long")


def vectors(docs: DataFrame, subject: str, id: str, text: str, bigrams: bool, cap: int, stop: tuple[str, ...] = fixed.STOP_WORDS) -> DataFrame:
    """(subject, id, terms, weights) of the documents, a written table; the vocabulary, its cap and the frequencies are each subject's own, and a term is its place there.

    A document without known terms has no row.
    """
    bags, known = counted(docs, subject, id, text, bigrams, cap, None, stop)
    idf = _by_place(known)
    listed = bags.join(idf, "subject").withColumn("xs", F.zip_with("terms", "counts", lambda t, c: c * F.get("idf", t)))
    norm = F.sqrt(F.aggregate("xs", F.lit(0.0), lambda a, x: a + x * x))
    # bound once: inside the function over the list the length would be taken anew for each term
    weights = let(norm, lambda n: F.transform("xs", lambda x: x / n))
    return materialise(listed.select("subject", "id", "terms", weights.alias("weights")), "vectors")


def _by_place(known: DataFrame) -> DataFrame:
    """(subject, idf): each vocabulary's weights, an array by place."""
    return known.groupBy("subject").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "idf"))), lambda x: x["idf"]).alias("idf"))


def postings(vectors: DataFrame, least: float) -> DataFrame:
    """(subject, term, id, w, rest): terms of each vector, and the length of what it holds from this term on, rare terms first; where that is `least` or more.

    Terms are numbered by how often they occur: a smaller number is a more frequent term, and comes later.
    """
    kind = dict(vectors.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, weights = batch.column(2), batch.column(3).flatten().to_numpy()
            size = np.diff(terms.offsets.to_numpy())
            total = np.concatenate([[0.0], np.cumsum(weights * weights)])
            begin = np.cumsum(size) - size
            rest = np.sqrt(np.maximum(total[1:] - np.repeat(total[begin], size), 0))
            kept = np.flatnonzero(rest >= least - SLACK)
            row = pa.array(np.repeat(np.arange(len(size)), size)[kept])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), terms.flatten().take(pa.array(kept)), batch.column(1).take(row), pa.array(weights[kept]), pa.array(rest[kept])], names=["subject", "term", "id", "w", "rest"]
            )

    return vectors.select("subject", "id", "terms", "weights").mapInArrow(run, f"subject {kind['subject']}, term int, id {kind['id']}, w double, rest double")


def met(left: DataFrame, right: DataFrame, on: list[str], deal: str, hot: int = HOT) -> DataFrame:
    """`left` joined with `right` on columns: a key with more than `hot` rows on the right is split, its rows on the left are dealt by `deal` into parts, each of which meets all on the right."""
    sizes = right.groupBy(*on).agg(F.ceil(F.count("*") / hot).cast("int").alias("parts"))
    dealt = left.join(sizes, on).withColumn("part", F.pmod(F.xxhash64(deal), F.col("parts")).cast("int")).drop("parts")
    every = right.join(sizes, on).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return dealt.join(every, [*on, "part"]).drop("part")


def candidates(vectors: DataFrame, least: float, hot: int = HOT) -> DataFrame:
    """(subject, a, b) of documents with a < b that may have a cosine above `least`.

    Along the terms, rare ones first, a pair's products are summed up as long as the lengths of what is left on both sides can still reach half of
    `least`; what is then not summed is less than that half, so that a pair whose sum is less than the other half can't reach it. Common
    terms are met only by vectors that consist of little else, and a pair that shares no rarer term is never formed.
    """
    half = least / 2
    index, at = written(postings(vectors, half), "postings")
    left = index.select("subject", "term", F.col("id").alias("a"), F.col("w").alias("x"), F.col("rest").alias("p"))
    right = index.select("subject", "term", F.col("id").alias("b"), F.col("w").alias("y"), F.col("rest").alias("q"))
    pairs_ = met(left, right, ["subject", "term"], "a", hot).where((F.col("a") < F.col("b")) & (F.col("p") * F.col("q") >= half - SLACK))
    summed = pairs_.groupBy("subject", "a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("sum")).where(F.col("sum") >= half - SLACK)
    found = materialise(summed.select("subject", "a", "b"), "candidates")
    remove(vectors.sparkSession, at)
    return found


def packed(rows: DataFrame) -> DataFrame:
    """(subject, block, data) of `rows` (subject, block, terms, other columns): what a batch has of one block, as compressed Arrow; terms as the steps between them."""
    names = [c for c in rows.columns if c not in ("subject", "block")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.select(["subject", "block"])
            for at in keys.to_pandas().groupby(["subject", "block"], sort=False).indices.values():
                own = batch.select(names).take(pa.array(at))
                terms = own.column("terms")
                flat, begin = terms.flatten().to_numpy(), terms.offsets.to_numpy()
                step = np.diff(flat, prepend=0)
                first = begin[:-1][np.diff(begin) > 0]
                step[first] = flat[first]
                steps = pa.ListArray.from_arrays(terms.offsets, pa.array(step.astype(np.int32)))
                own = pa.RecordBatch.from_arrays([steps if c == "terms" else own.column(c) for c in names], names=names)
                yield pa.RecordBatch.from_arrays([*(keys.column(i).take(pa.array(at[:1])) for i in (0, 1)), pa.array([_stream(pa.Table.from_batches([own]))])], names=["subject", "block", "data"])

    kind = dict(rows.dtypes)
    return rows.select("subject", "block", *names).mapInArrow(run, f"subject {kind['subject']}, block int, data binary")


def unpacked(data: list[bytes]) -> pa.Table:
    """The rows of `packed` data, terms still as steps."""
    return pa.concat_tables(pa.ipc.open_stream(x).read_all() for x in data).combine_chunks()


def places(steps: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Where the lists begin, and their terms: the steps of all lists summed up, less what was there before each of them."""
    size = np.diff(steps.offsets.to_numpy())
    begin = np.concatenate([[0], np.cumsum(size)])
    place = np.cumsum(steps.flatten().to_numpy().astype(np.int64))
    return begin, place - np.repeat(np.concatenate([[0], place])[begin[:-1]], size)


def pieces(n: Column, block: int = BLOCK) -> Column:
    """Into how many blocks n documents are dealt."""
    return F.greatest(F.least(F.lit(PIECES), F.ceil(n / SMALL)), F.ceil(n / block)).cast("int")


def dealt(data: DataFrame, sizes: DataFrame, side: int = 0) -> DataFrame:
    """(subject, i, j, side, data) of packed `data` for each two blocks i <= j of `sizes` (subject, pieces): `side` for what is of block i, the next number for what is of j."""
    n = data.join(sizes.select("subject", "pieces"), "subject").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    return n.select("subject", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.when(F.col("block") <= F.col("other"), side).otherwise(side + 1).alias("side"), "data")


def both(sizes: DataFrame) -> DataFrame:
    """`sizes` for each two blocks i <= j."""
    return sizes.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).withColumn("j", F.explode(F.sequence(F.col("i"), F.col("pieces") - 1)))


class Block:
    """The documents of a block by their owners: ids, owners, and vectors of length 1 as entries of a matrix."""

    def __init__(self, data: list[bytes], idf: np.ndarray | None) -> None:
        table = unpacked(data)
        owner = table.column("owner").to_numpy()
        order = np.argsort(owner, kind="stable")
        lists = [table.column(c).take(pa.array(order)).combine_chunks() for c in ("terms", "values")]
        self.id, self.owner = table.column("id").to_numpy()[order], owner[order]
        self.begin, self.term = places(lists[0])
        size = np.diff(self.begin)
        self.row = np.repeat(np.arange(len(size)), size)
        self.x = lists[1].flatten().to_numpy().astype(np.float64)
        if idf is not None:
            self.x = self.x * idf[self.term]
            self.x = self.x / np.sqrt(np.bincount(self.row, self.x * self.x, minlength=len(size)))[self.row]

    def tiles(self, most: int) -> list[tuple[int, int]]:
        return [(i, min(i + most, len(self.id))) for i in range(0, len(self.id), most)]

    def entries(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which of `docs`, terms, weights) of the entries of some documents."""
        size = self.begin[docs + 1] - self.begin[docs]
        at = np.repeat(self.begin[docs] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.repeat(np.arange(len(docs)), size), self.term[at], self.x[at]


def _cosines(a: Block, rows: np.ndarray, b: Block, columns: np.ndarray) -> np.ndarray:
    """Cosines of documents of `a` with documents of `b`: terms that many of both have are multiplied as matrices, others summed up along the documents that have them."""
    (i, s, x), (j, t, y) = a.entries(rows), b.entries(columns)
    m, n, top = len(rows), len(columns), max(s.max(initial=-1), t.max(initial=-1)) + 1
    held, there = np.bincount(s, minlength=top), np.bincount(t, minlength=top)
    often = np.flatnonzero(held * there > OFTEN * m * n)
    place = np.full(top, -1)
    place[often] = np.arange(len(often))
    out, width = np.zeros((m, n)), max(CELLS // max(m, n), 1)
    of, to = place[s], place[t]
    for k in range(0, len(often), width):
        left, right = np.zeros((m, min(width, len(often) - k))), np.zeros((n, min(width, len(often) - k)))
        p, q = (of >= k) & (of < k + width), (to >= k) & (to < k + width)
        left[i[p], of[p] - k], right[j[q], to[q] - k] = x[p], y[q]
        out += left @ right.T
    rare = (of < 0) & (there[s] > 0)
    i, s, x = i[rare], s[rare], x[rare]
    order = np.argsort(t.astype(np.uint16) if top <= 1 << 16 else t, kind="stable")
    j, y, first = j[order], y[order], np.cumsum(there) - there
    size = there[s]
    reach = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(i, np.arange(m + 1))]
    row = 0
    while row < m and len(i):
        # as many rows as bring SUMS products, one at least
        end = max(int(np.searchsorted(reach, reach[row] + SUMS, side="right")) - 1, row + 1)
        at = slice(*np.searchsorted(i, [row, end]))
        c = size[at]
        entry = np.repeat(first[s[at]] - (np.cumsum(c) - c), c) + np.arange(c.sum())
        cell = np.repeat((i[at] - row) * n, c) + j[entry]
        out[row:end] += np.bincount(cell, np.repeat(x[at], c) * y[entry], minlength=(end - row) * n).reshape(end - row, n)
        row = end
    return out


def _tiles(a: Block, b: Block | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Documents of `a` and of `b` that meet, or of `a` with itself each tile once."""
    for q in (b or a).tiles(TILE):
        for p in a.tiles(TILE):
            if b is not None or p[0] <= q[0]:
                yield np.arange(*p), np.arange(*q)


def _linked(a: Block, b: Block | None, least: float, _: None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, ids, cosines) of pairs above `least`, smaller ids first."""
    other = b or a
    for rows, columns in _tiles(a, b):
        found = _cosines(a, rows, other, columns)
        i, j = np.nonzero(np.triu(found, 1) > least - SLACK if b is None and rows[0] == columns[0] else found > least - SLACK)
        x, y, cosine = a.id[rows[i]], other.id[columns[j]], found[i, j]
        kept = (np.round(cosine, 9) > least) & (x != y)
        x, y = x[kept], y[kept]
        yield np.where(x < y, x, y), np.where(x < y, y, x), cosine[kept]


def _runs(x: np.ndarray) -> np.ndarray:
    """Where equal values that follow each other begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))


def _owners(a: Block, b: Block | None, least: float, sure: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(owners, owners, greatest cosines) of pairs of two owners with a cosine above `least`, smaller owners first: taken a tile at a time, as documents lie by owner.

    What is `sure`, pairs of owners in the order of the first ones, is left out.
    """
    other = b or a
    for rows, columns in _tiles(a, b):
        x, y = a.owner[rows], other.owner[columns]
        i, j = _runs(x), _runs(y)
        u, v = x[i], y[j]
        wanted = u[:, None] != v[None, :]
        if b is None and rows[0] == columns[0]:
            wanted = np.triu(wanted)
        if sure is not None:
            _without(wanted, u, v, sure)
            _without(wanted.T, v, u, sure)
        for some in _groups(wanted, np.diff(i, append=len(x)), np.diff(j, append=len(y))):
            there = np.flatnonzero(wanted[some].any(axis=1))
            to = np.flatnonzero(wanted[some].any(axis=0))
            if not len(there):
                continue
            there += some.start
            held, k = _documents(i, len(x), there)
            met_, l = _documents(j, len(y), to)
            found = _cosines(a, rows[held], other, columns[met_])
            best = np.maximum.reduceat(np.maximum.reduceat(found, k, axis=0), l, axis=1)
            p, q = np.nonzero((np.round(best, 9) > least) & wanted[np.ix_(there, to)])
            one, two = u[there[p]], v[to[q]]
            yield np.where(one < two, one, two), np.where(one < two, two, one), best[p, q]


def _groups(wanted: np.ndarray, size: np.ndarray, there: np.ndarray) -> list[slice]:
    """Owners whose documents are multiplied together: as many as have GROUP documents where that leaves out half of the pairs, else all."""
    at = _runs((np.cumsum(size) - size) // GROUP)
    met_ = np.logical_or.reduceat(wanted, at, axis=0) @ there
    if 2 * (np.add.reduceat(size, at) * met_).sum() > size.sum() * there.sum():
        return [slice(0, len(size))]
    return [slice(i, j) for i, j in zip(at, [*at[1:], len(size)], strict=True)]


def _documents(begin: np.ndarray, n: int, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, where each run begins among them) of the documents of some runs."""
    size = np.diff(begin, append=n)[runs]
    first = np.cumsum(size) - size
    return np.repeat(begin[runs] - first, size) + np.arange(size.sum()), first


def _without(wanted: np.ndarray, u: np.ndarray, v: np.ndarray, sure: tuple[np.ndarray, np.ndarray]) -> None:
    """Strikes out of `wanted` the pairs (u, v) that are `sure`."""
    one, two = (x[slice(np.searchsorted(sure[0], u[0]), np.searchsorted(sure[0], u[-1], side="right"))] for x in sure)
    i, j = np.searchsorted(u, one), np.searchsorted(v, two)
    j = np.minimum(j, len(v) - 1)
    here = (u[i] == one) & (v[j] == two)
    wanted[i[here], j[here]] = False


def _met_in_blocks(rows: DataFrame, idf: DataFrame | None, least: float, owners: bool, sure: Broadcast | None = None) -> DataFrame:
    """(subject, a, b, cosine) of `rows` (subject, id, owner, n, terms, values): all pairs of documents, or the greatest of each pair of owners in a tile.

    A subject's documents are dealt into PIECES blocks, or more where a block would have over BLOCK documents, and two blocks at a time meet in a task.
    What moves is each document PIECES times, packed; no pair is moved or kept before it is known to be a link. The work is that of all pairs, but for
    those of owners that are `sure` (owners, owners, subjects in order, the last such subject of each pair) in this subject or a later one.
    """
    kind = dict(rows.dtypes)
    end = kind["owner" if owners else "id"]
    schema = f"subject {kind['subject']}, a {end}, b {end}, cosine double"
    parts = pieces(F.col("n"))
    blocks = rows.select("subject", F.pmod(F.xxhash64("id"), parts).cast("int").alias("block"), "id", "owner", "terms", "values")
    sizes = rows.groupBy("subject").agg(F.max(parts).alias("pieces"))
    met_ = dealt(packed(blocks), sizes)
    if idf is not None:
        # the weights of a vocabulary go with the number of each pair of blocks, not with the documents
        met_ = met_.unionByName(both(sizes.join(idf, "subject")).mapInArrow(_as_data, f"subject {kind['subject']}, i int, j int, side int, data binary"))

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[int, list[bytes]] = {-1: [], 0: [], 1: []}
        for batch in batches:
            for side, data in zip(batch.column("side").to_pylist(), batch.column("data").to_pylist(), strict=True):
                of[side].append(data)
        weights = np.frombuffer(of[-1][0]) if of[-1] else None
        same = key[1].as_py() == key[2].as_py()
        if not of[0] or not (same or of[1]):
            return
        a, b = Block(of[0], weights), None if same else Block(of[1], weights)
        known = None
        if sure is not None:
            one, two, subjects, last = sure.value
            held = last >= bisect_left(subjects, key[0].as_py())
            known = one[held], two[held]
        for x, y, cosine in (_owners if owners else _linked)(a, b, least, known):
            for k in range(0, len(x), ROWS):
                columns = [pa.array(x[k : k + ROWS]), pa.array(y[k : k + ROWS]), pa.array(cosine[k : k + ROWS])]
                subject = pa.repeat(key[0], len(columns[0]))
                yield pa.RecordBatch.from_arrays([subject, *columns], names=["subject", "a", "b", "cosine"])

    return met_.repartition(shares(sizes), "subject", "i", "j").groupBy("subject", "i", "j").applyInArrow(run, schema)


def shares(sizes: DataFrame) -> int:
    """Into how many partitions the pairs of blocks of `sizes` are dealt, so that few of them wait for each other in one task."""
    return int(min(max(2 * (sizes.agg(F.sum(F.col("pieces") * (F.col("pieces") + 1) / 2)).first()[0] or 0), 8), SHARES))


def _as_data(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A vocabulary's weights for each pair of blocks, as side -1."""
    for batch in batches:
        data = [np.asarray(x, dtype=np.float64).tobytes() for x in batch.column("idf").to_pylist()]
        columns = [batch.column("subject"), batch.column("i"), batch.column("j"), pa.array([-1] * len(data), pa.int32()), pa.array(data, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["subject", "i", "j", "side", "data"])


def pairs(vectors: DataFrame, least: float) -> DataFrame:
    """(subject, a, b, cosine) of documents of one subject with a < b and a cosine above `least`, from their `vectors`."""
    size = vectors.groupBy("subject").agg(F.count("*").alias("n"))
    rows = vectors.join(size, "subject").select("subject", "id", F.lit(0).alias("owner"), "n", "terms", F.col("weights").alias("values"))
    return _met_in_blocks(rows, None, least, False)


def linked(docs: DataFrame, subject: str, id: str, text: str, cap: int, least: float) -> DataFrame:
    """What `pairs` gives of the documents' `vectors`, from counts, which are a quarter as large."""
    bags, known = counted(docs, subject, id, text, False, cap)
    return _met_in_blocks(bags.withColumnRenamed("counts", "values"), _by_place(known), least, False)


def linked_owners(docs: DataFrame, subject: str, id: str, owner: str, text: str, cap: int, least: float, overall: bool = False) -> DataFrame:
    """(subject, a, b, cosine) of two owners with documents of one subject above `least`: the greatest cosine; an owner without a name has no links.

    With `overall`, two owners whose documents have equal vectors in a subject need not have a row in it or in earlier ones, but have one with 1.0
    in the last of these: none of the others is greater, and of equals it comes last.
    """
    bags, known = counted(docs, subject, id, text, False, cap, owner)
    named = bags.where(F.col("owner").isNotNull())
    sure, same = None, None
    if overall and least < 1:
        same = materialise(_copies(named), "copies")
        if same.count() <= KNOWN:
            table = same.toArrow().sort_by([("a", "ascending"), ("b", "ascending")])
            subjects = sorted(set(table.column("subject").to_pylist()))
            last = pc.index_in(table.column("subject"), value_set=pa.array(subjects, table.column("subject").type)).to_numpy()
            sure = docs.sparkSession.sparkContext.broadcast((table.column("a").to_numpy(), table.column("b").to_numpy(), subjects, last))
    found = _met_in_blocks(named.withColumnRenamed("counts", "values"), _by_place(known), least, True, sure)
    found = found.unionByName(same.select("subject", "a", "b", F.lit(1.0).alias("cosine"))) if same is not None else found
    return found.groupBy("subject", "a", "b").agg(F.max("cosine").alias("cosine"))


def _copies(bags: DataFrame) -> DataFrame:
    """(a, b, subject) of two owners with documents of equal terms and counts, or equal terms and one count each, whose cosine is 1: the last subject where they have such."""
    one = F.array_min("counts") == F.array_max("counts")
    alike = bags.select("subject", "owner", "terms", F.when(one, F.transform("counts", lambda x: F.lit(1))).otherwise(F.col("counts")).alias("counts"))
    keyed = alike.withColumn("key", F.xxhash64("terms", "counts"))
    often = keyed.groupBy("subject", "key").agg(F.min("owner").alias("first"), F.max("owner").alias("last")).where("first < last").select("subject", "key")
    group = keyed.join(often, ["subject", "key"], "left_semi").groupBy("subject", "terms", "counts").agg(F.array_sort(F.collect_set("owner")).alias("owners"))
    first = group.where(F.size("owners") > 1).select("subject", "owners", F.posexplode("owners").alias("at", "a"))
    both_ = first.select("subject", "a", F.explode(F.slice("owners", F.col("at") + 2, F.size("owners"))).alias("b"))
    return both_.groupBy("a", "b").agg(F.max("subject").alias("subject"))


def peer_scores(docs: DataFrame, subject: str, id: str, student: str, text: str) -> DataFrame:
    """Each document against other students' of its subject, as `peers.scores`, however short the texts are."""
    from veritrail.operators import peers  # which builds on this module

    return peers.scores(docs, subject, id, student, text, least=0)


def visual_duplicates(docs: DataFrame, hash: str, id: str, student: str) -> DataFrame:
    """Whether another student has handed in a document with the same visual hash: groups are summed up, no pairs are formed."""
    seen = docs.where(F.col(hash).isNotNull()).groupBy(hash).agg(F.min(student).alias("first"), F.max(student).alias("last"))
    return docs.join(seen, hash, "left").select(id, F.coalesce(F.col("first") != F.col("last"), F.lit(False)).alias("duplicate"))
