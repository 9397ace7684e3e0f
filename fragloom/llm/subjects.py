"""Subjects of documents: term weighting, truncated singular value decomposition, and seed centroids refined iteratively.

1. Terms are the parts of names, comments and strings (``tokenCount`` and ``token_count`` are token, count). Licence headers,
   lines that say where a file came from, and passages of test items are left out.
2. A term counts if it is in at least ``MIN_SHARE`` of all documents, or in ``MIN_DOCUMENTS`` of the seeds, so that a rare subject
   keeps its words. One in more than ``FREQUENT`` of all documents is left out where the seeds show that it tells no subject from
   the others: in none is its share of the seeds ``SEPARATES`` times that of the other seeds. However large a part of the corpus a subject is, its own terms stay. A weight is
   ``(1 + ln tf) / sqrt(df * sum of (1 + ln tf) over the document)``, which gives every term the same pull, rare or not.
3. The weights' leading ``DIMENSIONS`` right singular vectors come from subspace iteration: each round is one pass over all
   documents that adds up, in the tasks, the product of the weights with themselves and a matrix of (terms x dimensions).
   That matrix is all the driver sees. It is bounded: with T terms in a document on average, T / MIN_SHARE terms can count, and
   T * SEEDS / MIN_DOCUMENTS of the seeds.
4. A subject's centroid is the mean of its seeds' embeddings; each round adds every document that lies close. Some seeds lie
   far from their subject's centroid because they use other words for it, such as those of another language: in the space
   left by the first centroids they make a second one for the subject, if they are alike, refined in the same way.
5. A term belongs to the subject whose centroids it lies closest to, if no other subject is near. A document is about the
   subjects to which its cosine is at least ``LEAST_COSINE`` and whose terms it mentions at least ``LEAST_MENTIONS`` times.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragloom.llm.leaks import least_run
from fragloom.llm.runs import item_parts, item_runs, run_filter
from fragloom.session import Scratch

MIN_SHARE, MIN_DOCUMENTS, FREQUENT, SEPARATES = 1 / 5000, 3, 1 / 20, 4
SEEDS = 20_000  # labelled documents that the subjects are fitted to at most, the first by a hash of their number
DIMENSIONS, OVERSAMPLED, PASSES = 64, 10, 4
CLOSE, CLOSE_SECOND, FAR, ALIKE = 0.6, 0.5, 0.3, 0.05
TERM_COSINE, TERM_RIVAL = 0.2, 0.7
LEAST_COSINE, LEAST_MENTIONS = 0.1, 2
JOINED = 12  # words between two runs of a test item that still count as one passage
_BLOCK = 1024  # rows of a matrix in one block
_FAN_IN = 64  # blocks that one group adds up

_WORD = re.compile(r"[^\W_]+")
_PART = re.compile(r"[A-Z]?[^\W\d_A-Z]+|[A-Z]+(?![^\W\d_A-Z])")
_MARK = re.compile(r"[\s\ufeff]*(//|#(?!(?:include|define|undef|if|ifdef|ifndef|else|elif|endif|pragma)\b)|--|<!--|/?\*+|;+(?=\s)|%+(?=\s))")
_BLANK = re.compile(r"[\s\ufeff]*")
#: How notes on rights and on generators are usually worded.
_WRITER = r"(?:auto(?:matically)?|machine|computer|tool)[- ]?(?:generated|written|made|created)"
_MADE = rf"(?:@generated\b|(?:(?:this (?:file|code) (?:was|is) |code )?(?:{_WRITER}|generated)) by\b)"
_CLOSED = r"\bnot\s+for\s+(?:release|distribution|publication|resale|reuse)\b"
_TERMS = r"\bunder\s+(?:the|a|an)\s+[\w\s.-]{0,60}\b(?:licen[cs]e|terms)\b"
#: In a comment at the top.
_LEGAL = re.compile(rf"(?i)\b(?:copyright|licen[cs]e[ds]?|spdx|licenseref|all rights|rights (?:granted|reserved)|confidential|proprietary)\b|{_CLOSED}|{_TERMS}")
_GENERATED = re.compile(rf"(?i){_MADE}|\b{_WRITER}\b|\bdo not (?:change|edit|modify)(?: (?:this|it|by)\b|\W*$)")
#: In text without a comment mark, where a word alone says little.
_NOTICE = re.compile(rf"(?i)\bcopyright\s+(?:\(c\)|©|\d{{4}})|\(c\)\s+\d{{4}}\b|\bspdx-|\ball\s+rights\s+(?:reserved|not\s+granted)\b|{_CLOSED}|\blicen[cs]ed\s+under\b|{_TERMS}|\bsee\s+the\s+licen[cs]e\s+file\b")
_TAIL = re.compile(r"(?i)\b(?:this\s+notice|liability|warrant(?:y|ies)|without\s+(?:(?:a|an|the|prior|express)\s+)*written\s+(?:consent|contract|permission|agreement)|do\s+not\s+(?:pass\s+on|distribute|redistribute|share|copy))\b")
_CLAUSE = re.compile(rf"(?i)[\s\ufeff]*{_MADE}(?:(?<!@generated)[ \t]+[\w-]+(?:[ \t]+v?\d[\w.]*)?)?(?:[;,.][ \t]*do not (?:change|edit|modify)(?: by hand)?\b\.?)?")
_SENTENCE = re.compile(r"\S.{0,400}?(?:[.!?](?=\s|$)|$(?!\n)|(?=\n[^\S\n]*(?:\n|$)))", re.S)
_CODE = re.compile(r"[{}<>=\[\]\"|\\$`]|\w\(")
_MOVED = ("copied", "produced", "generated", "taken", "vendored")
_ORIGIN = re.compile(rf"(?i)\b(?:this file (?:was|is) )?(?:{'|'.join(_MOVED)}) from\s+[\w.~@-]*[/.\\]\w[^\s,;'\"<>(){{}}]*")
_LONG = 200  # characters; a longer line holds more than a note


def _unmarked_notice(text: str, at: int) -> int:
    """The end of the notice without a comment mark at ``at``; ``at`` if there is none. It ends with its last sentence that is legal."""
    made = _CLAUSE.match(text, at)
    if made:
        line = text.find("\n", made.end()) + 1 or len(text)
        rest = text[made.end() : line]
        return made.end() if _CODE.search(rest) or len(rest) > _LONG else line
    end = here = at
    for n in range(6):
        found = _SENTENCE.match(text, _BLANK.match(text, here).end())
        if not found or _CODE.search(found[0]) or re.search(r"\n[^\S\n]*\n", text[here : found.start()]) and n:
            break
        here = found.end()
        if _NOTICE.search(found[0]) or (end > at and _TAIL.search(found[0])):
            end = here
        elif n > 0 and end == at:
            break
    blank = re.compile(r"[^\S\n]*\n").match(text, end)
    return blank.end() if end > at and blank else end


def _marked_notice(text: str, at: int, mark: str) -> tuple[int, str]:
    """(end, what stays of it) of the comment at ``at``, which begins with ``mark``; the end is ``at`` if it is no notice."""
    close = {"/*": "*/", "<!": "-->"}.get(mark[:2])
    shut = text.find(close, at) if close else -1
    if shut >= 0 and "<!--" not in text[text.find(mark, at) + len(mark) : shut]:
        end = shut + len(close)
        comment = text[at:end]
        if not _LEGAL.search(comment) and not (len(comment) <= 2 * _LONG and _GENERATED.search(comment.removesuffix(close))):
            return at, ""
        blank = re.compile(r"[^\S\n]*\n").match(text, end)
        return (blank.end() if blank else end), ""
    end, lines = at, []
    while end < len(text):
        line = text.find("\n", end) + 1 or len(text)
        own = _MARK.match(text, end, line)
        if not own or own[1] != mark:
            break
        lines.append(text[end:line])
        end = line
    if _LEGAL.search("".join(lines)):
        return end, ""
    kept = [x for x in lines if not _GENERATED.search(x.rstrip())]
    return (end, "".join(kept)) if len(kept) < len(lines) else (at, "")


def _without_origin(line: str) -> str | None:
    """The line without where it came from; None if it says nothing else."""
    found = _ORIGIN.search(line)
    if not found:
        return line
    mark = _MARK.match(line)
    if len(line) <= _LONG and (mark or not _CODE.search(line)) and not line[mark.end() if mark else 0 : found.start()].strip(" \t\ufeff*"):
        return None
    return _ORIGIN.sub(" ", line)


def body(text: str) -> str:
    """The text without the licence and generator notes at its top and without what says where it came from.

    A note is a run of lines with the same comment mark, one block comment, or, without a mark, some sentences without code. Of
    a run that only names a generator the lines that do so go, of a long line the clause.
    """
    at, kept = 0, ""
    while True:
        first = _BLANK.match(text, at).end()
        if first == len(text):
            break
        first = max(at, text.rfind("\n", at, first) + 1)
        mark = _MARK.match(text, first)
        end, stays = _marked_notice(text, first, mark[1]) if mark else (_unmarked_notice(text, first), "")
        if end == first:
            break
        at, kept = end, kept + stays
    rest = kept + text[at:]
    lower = rest.lower()
    if not any(f"{verb} from" in lower for verb in _MOVED) or not _ORIGIN.search(rest):
        return rest
    return "\n".join(x for x in map(_without_origin, rest.split("\n")) if x is not None)


def _masked(first: list[int], n: int, least: int) -> np.ndarray:
    """Which of n words are part of a passage of a test item, given the first words of the runs that it shares with one."""
    mask = np.zeros(n, dtype=bool)
    last = None
    for j in sorted(first):
        mask[j : j + least] = True
        if last is not None and j - last <= least + JOINED:
            mask[last:j] = True
        last = j
    return mask


class _Looked(dict):
    """The number of each word in lower case, and its parts that are terms, made when the word is first seen."""

    def __missing__(self, word: str) -> tuple[int, list[str]]:
        if len(self) > 300_000:
            self.clear()
        self[word] = out = (crc32(word.lower().encode("utf-8", "surrogatepass")), [p.lower() for p in _PART.findall(word) if len(p) > 2])
        return out


def _words_of(text: str, looked: _Looked) -> list[tuple]:
    return list(map(looked.__getitem__, _WORD.findall(body(text))))


def document_terms(documents: DataFrame, items: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, terms, counts) of every document with a text; whole texts are read.

    One pass counts the terms, and keeps the texts that may hold a run of a test item; those are counted again without the
    passages around the runs that really are an item's, found by a join.
    """
    spark = documents.sparkSession
    least = least_run()
    runs = scratch.table(item_runs(item_parts(items), least).select(F.explode("runs").alias("run")).distinct())
    sent = spark.sparkContext.broadcast(run_filter(runs, least))

    def counted(found: list[tuple]) -> tuple[list[str], list[int]]:
        n = Counter(chain.from_iterable(f[1] for f in found))
        return list(n), list(n.values())

    names = ["doc_id", "terms", "counts", "text", "at", "runs"]
    types = [pa.list_(pa.string()), pa.list_(pa.int32()), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64())]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, looked = sent.value, _Looked()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            own = [_words_of(text, looked) for text in texts]
            lengths = np.fromiter(map(len, own), np.int64, len(own))
            which, at, runs = known.hits(np.fromiter((f[0] for f in chain.from_iterable(own)), np.uint64, int(lengths.sum())), lengths)
            parts = np.searchsorted(which, np.arange(len(own) + 1))
            rows = []
            for found, text, a, b in zip(own, texts, parts.tolist(), parts[1:].tolist()):
                rows.append(([], [], text, at[a:b], runs[a:b]) if b > a else (*counted(found), None, [], []))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types)]], names)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looked = _Looked()
        for batch in batches:
            rows = []
            for text, at in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found = _words_of(text, looked)
                gone = _masked(at or [], len(found), least)
                rows.append(counted([f for f, out in zip(found, gone) if not out]))
            cols = list(zip(*rows)) or [()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types)]], names[:3])

    rows = documents.where("text IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint"), "text")
    passed = rows.mapInArrow(first, "doc_id bigint, terms array<string>, counts array<int>, text string, at array<int>, runs array<bigint>")
    passed = scratch.table(passed.withColumn("row", F.monotonically_increasing_id()))
    held = passed.where("text IS NOT NULL")
    hits = held.select("row", F.inline(F.arrays_zip("at", "runs"))).withColumnRenamed("runs", "run").join(runs.hint("merge"), "run").groupBy("row").agg(F.collect_list("at").alias("at"))
    masked = held.select("row", "doc_id", "text").join(hits.hint("merge"), "row", "left").select("doc_id", "text", "at").mapInArrow(again, "doc_id bigint, terms array<string>, counts array<int>")
    return passed.where("text IS NULL").select("doc_id", "terms", "counts").unionByName(masked)


def _in_both(terms: DataFrame, single: dict[str, str]) -> Counter:
    """The number of documents that have both the plural and its singular, by singular, where ``single`` has the singular of each plural."""
    sent = terms.sparkSession.sparkContext.broadcast(single)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, of = Counter(), sent.value
        for batch in batches:
            for names in batch.column(0).to_pylist():
                own = set(names)
                n.update({of[t] for t in own if t in of and of[t] in own})
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["term", "n"])

    sums = terms.select("terms").mapInArrow(run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    return Counter({r["term"]: r["n"] for r in sums.collect()})


def _separating(terms: DataFrame, labels: DataFrame, single: dict[str, str]) -> set[str]:
    """The terms that tell a subject from the others by the seeds, of those that are values of ``single``."""
    seeds = terms.join(labels, "doc_id").select("terms", "labels")
    sent = terms.sparkSession.sparkContext.broadcast(single)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, of = Counter(), sent.value
        for batch in batches:
            for names, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for t in ("", *{of[t] for t in names if t in of}):  # "" stands for all seeds, -1 for any subject
                    n.update((t, s) for s in (-1, *own))
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in n], pa.string()), pa.array([s for _, s in n], pa.int32()), pa.array(list(n.values()), pa.int64())], ["term", "s", "n"])

    sums = seeds.mapInArrow(run, "term string, s int, n bigint").groupBy("term", "s").agg(F.sum("n").alias("n"))
    n = {(r["term"], r["s"]): r["n"] for r in sums.collect()}  # at most (terms of an average document) / FREQUENT, times the subjects
    found = set()
    for (t, s), inside in n.items():
        if t and s >= 0:
            size = n["", s]
            outside = (n[t, -1] - inside + 0.5) / (n["", -1] - size + 1)
            if (inside + 0.5) / (size + 1) >= SEPARATES * outside:
                found.add(t)
    return found


def vocabulary(terms: DataFrame, n: int, labels: DataFrame) -> tuple[dict[str, int], np.ndarray]:
    """(number of each term that counts, document frequency by number); a plural in s has the number of its singular.

    ``labels`` (doc_id, labels) are the seeds' subjects.
    """
    least = max(MIN_DOCUMENTS, n * MIN_SHARE)
    each = lambda rows: rows.select(F.explode("terms").alias("term")).groupBy("term")
    seeded = each(terms.join(labels, "doc_id")).agg(F.count(F.lit(1)).alias("seeds")).where(F.col("seeds") >= MIN_DOCUMENTS)
    df = each(terms).agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= MIN_DOCUMENTS).join(seeded, "term", "left").where((F.col("df") >= least) | F.col("seeds").isNotNull())
    counts = {r["term"]: r["df"] for r in df.select("term", "df").collect()}  # at most (terms of an average document) / MIN_SHARE, and those of SEEDS documents
    single = {t: t[:-1] if t.endswith("s") and counts.get(t[:-1], 0) >= counts[t] else t for t in counts}
    both = _in_both(terms, {t: s for t, s in single.items() if s != t})
    total = Counter()
    for t, s in single.items():
        total[s] += counts[t]
    total.subtract(both)
    frequent = {s for s in total if total[s] > FREQUENT * n}
    separating = _separating(terms, labels, {t: s for t, s in single.items() if s in frequent}) if frequent else set()
    number: dict[str, int] = {}
    for t in sorted(t for t in counts if single[t] == t and (t not in frequent or t in separating)):
        number[t] = len(number)
    freq = np.array([total[t] for t in number], dtype=np.float64)
    return number | {t: number[s] for t, s in single.items() if s != t and s in number}, freq


def document_vectors(terms: DataFrame, number: dict[str, int], labels: DataFrame) -> DataFrame:
    """(doc_id, ids, tf, labels): numbers and counts of the terms that count, of documents that have some; ``labels`` are the seeds' subjects."""
    sent = terms.sparkSession.sparkContext.broadcast(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = sent.value.get
        for batch in batches:
            ids, tf, keep = [], [], []
            for at, (names, counts) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                own: dict[int, int] = {}
                for name, count in zip(names, counts):
                    k = get(name)
                    if k is not None:
                        own[k] = own.get(k, 0) + count
                if own:
                    keep.append(at)
                    ids.append(list(own))
                    tf.append(list(own.values()))
            kept = batch.column(0).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept, pa.array(ids, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int32()))], ["doc_id", "ids", "tf"])

    return terms.mapInArrow(run, "doc_id bigint, ids array<int>, tf array<int>").join(labels, "doc_id", "left")


class Sparse:
    """The weights of one batch of documents."""

    def __init__(self, batch: pa.RecordBatch, scale: np.ndarray):
        ids, tf = batch.column(1), batch.column(2)
        self.rows = batch.num_rows
        self.cols = ids.flatten().to_numpy()
        self.starts = np.asarray(ids.offsets)[:-1] - ids.offsets[0].as_py()
        self.tf = tf.flatten().to_numpy()
        log = 1 + np.log(self.tf)
        sums = np.add.reduceat(log, self.starts)
        self.lengths = np.diff(np.append(self.starts, len(self.cols)))
        self.weights = (log * scale[self.cols] / np.sqrt(np.repeat(sums, self.lengths))).astype(np.float32)

    def times(self, q: np.ndarray) -> np.ndarray:
        return np.add.reduceat(q[self.cols] * self.weights[:, None], self.starts, axis=0)

    def add_transposed(self, y: np.ndarray, out: np.ndarray) -> None:
        """Adds the transposed weights times ``y`` to ``out``."""
        order = np.argsort(self.cols, kind="stable")
        cols = self.cols[order]
        first = np.flatnonzero(np.concatenate(([True], cols[1:] != cols[:-1])))
        of = np.repeat(np.arange(self.rows), self.lengths)[order]
        out[cols[first]] += np.add.reduceat(y[of] * self.weights[order, None], first, axis=0)


def _added_up(vectors: DataFrame, shape: tuple[int, int], each: Callable[[pa.RecordBatch, np.ndarray], None]) -> np.ndarray:
    """The sum over all documents of what ``each`` adds to a matrix of ``shape``: added up in the tasks, then block by block of its rows.

    Blocks are added in a tree, so that a group holds ``_FAN_IN`` of them at most, however many tasks there were.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(shape, dtype=np.float64)
        seen = False
        for batch in batches:
            if batch.num_rows:
                each(batch, out)
                seen = True
        if seen:
            blocks = range(0, shape[0], _BLOCK)
            node = pa.array([TaskContext.get().partitionId()] * len(blocks), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int64()), node, pa.array([out[b : b + _BLOCK].tobytes() for b in blocks], pa.binary())], ["block", "node", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, dtype=np.float64) for x in table.column("sums").to_pylist())
        return pa.table({"block": table.column("block")[:1], "node": table.column("node")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    schema = "block bigint, node bigint, sums binary"
    sums, tasks = vectors.mapInArrow(part, schema), vectors.rdd.getNumPartitions()
    while tasks > 1:
        sums = sums.withColumn("node", F.expr(f"node div {_FAN_IN}")).groupBy("block", "node").applyInArrow(add, schema)
        tasks = -(-tasks // _FAN_IN)
    out = np.zeros(shape)
    for row in sums.collect():  # as many rows as the matrix has blocks
        own = np.frombuffer(bytes(row["sums"]), dtype=np.float64).reshape(-1, shape[1])
        out[row["block"] : row["block"] + len(own)] = own
    return out


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)


def singular_vectors(vectors: DataFrame, scale: np.ndarray, k: int = DIMENSIONS) -> np.ndarray:
    """(terms x k): the leading right singular vectors of the weights of all documents, by subspace iteration."""
    width = min(len(scale), k + OVERSAMPLED)
    q = np.linalg.qr(np.random.default_rng(0).standard_normal((len(scale), width)))[0].astype(np.float32)
    for n in range(PASSES):
        sent = vectors.sparkSession.sparkContext.broadcast((q, scale))

        def each(batch: pa.RecordBatch, out: np.ndarray, sent=sent) -> None:
            own, by = sent.value
            x = Sparse(batch, by)
            x.add_transposed(x.times(own), out)

        z = _added_up(vectors, q.shape, each)
        if n < PASSES - 1:
            q = np.linalg.qr(z)[0].astype(np.float32)
    values, turn = np.linalg.eigh(q.T.astype(np.float64) @ z)
    return (q @ turn[:, np.argsort(-values)[:k]]).astype(np.float32)


def _labels(batch: pa.RecordBatch, n: int) -> np.ndarray:
    out = np.zeros((batch.num_rows, n))
    for at, own in enumerate(batch.column(3).to_pylist()):
        for s in own or ():
            out[at, s] = 1 / len(own)
    return out


def centroids(vectors: DataFrame, basis: np.ndarray, scale: np.ndarray, n: int, rounds: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(first, second): unit centroids of the n subjects; zero where a subject has none."""
    context = vectors.sparkSession.sparkContext
    k = basis.shape[1]
    seeds = vectors.where("labels IS NOT NULL")

    def first_pass(rows: DataFrame, now: np.ndarray | None) -> np.ndarray:
        sent = context.broadcast((basis, scale, now))

        def each(batch: pa.RecordBatch, out: np.ndarray) -> None:
            own, by, at = sent.value
            e = _unit(Sparse(batch, by).times(own))
            share = _labels(batch, n)
            if at is not None:
                close = e @ at.T >= CLOSE
                share = share + close / np.maximum(1, close.sum(axis=1, keepdims=True))
            out += share.T @ e

        return _unit(_added_up(rows, (n, k), each))

    first = first_pass(seeds, None)
    for _ in range(rounds):
        first = first_pass(vectors, first)
    used = np.linalg.norm(first, axis=1) > 0.5
    span = np.linalg.qr(first[used].T)[0] if used.any() else np.zeros((k, 0))

    def second_pass(rows: DataFrame, now: np.ndarray | None) -> np.ndarray:
        sent = context.broadcast((basis, scale, first, span, now))

        def each(batch: pa.RecordBatch, out: np.ndarray) -> None:
            own, by, main, seen, at = sent.value
            e = _unit(Sparse(batch, by).times(own))
            rest = e - (e @ seen) @ seen.T
            length = np.linalg.norm(rest, axis=1)
            rest = _unit(rest)
            share = (_labels(batch, n) > 0) & (e @ main.T < FAR) & (length > 0.5)[:, None]
            share = share / np.maximum(1, share.sum(axis=1, keepdims=True))
            if at is not None:
                cosine = rest @ at.T
                close = np.flatnonzero((cosine.max(axis=1) >= CLOSE_SECOND) & (length > 0.5))
                share[close, cosine[close].argmax(axis=1)] += 1
            out[:, :-1] += share.T @ rest
            out[:, -1] += share.sum(axis=0)

        sums = _added_up(rows, (n, k + 1), each)
        count = sums[:, -1:]
        mean = sums[:, :-1] / np.maximum(count, 1)
        # of unit vectors, the mean cosine of two different ones; near 0 where they point anywhere
        alike = (count * (mean**2).sum(axis=1, keepdims=True) - 1) / np.maximum(count - 1, 1e-9)
        # what all of them have in common says nothing about a subject
        return _unit(mean - mean.mean(axis=0)) * ((count >= 2) & (alike >= ALIKE))

    second = second_pass(seeds, None)
    for _ in range(rounds if second.any() else 0):
        second = second_pass(vectors, second)
    return first, second


def term_subjects(basis: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The subject of each term, -1 for none."""
    unit = _unit(basis)
    cosine = np.maximum(unit @ first.T, unit @ second.T)
    best = cosine.argmax(axis=1)
    ranked = np.sort(cosine, axis=1)
    rival = ranked[:, -2] if cosine.shape[1] > 1 else np.zeros(len(cosine))
    return np.where((ranked[:, -1] >= TERM_COSINE) & (rival < TERM_RIVAL * ranked[:, -1]), best, -1)


def document_subjects(documents: DataFrame, seeds: DataFrame, subjects: list[str], items: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, subject): the subjects, among ``subjects``, of every document.

    ``seeds`` (doc_id, subject) are documents with all their subjects; null values, repeated rows, subjects that are not in
    ``subjects`` and documents that do not exist are ignored. ``items`` (item_id, prompt, solution) are test items whose
    passages are not read as part of a document. Null and empty texts have no subject; nor has any document where there are
    no seeds. Documents that occur twice give their rows once. Other columns are not read.
    """
    spark = documents.sparkSession
    terms = scratch.table(document_terms(documents, items, scratch))
    n = terms.count()
    if not subjects:
        return spark.createDataFrame([], "doc_id bigint, subject string")
    place = F.array_position(F.array(*[F.lit(s) for s in subjects]), F.col("subject")) - 1
    labels = seeds.where("doc_id IS NOT NULL AND subject IS NOT NULL").select(F.col("doc_id").cast("bigint"), place.cast("int").alias("s")).where("s >= 0").groupBy("doc_id").agg(F.array_sort(F.collect_set("s")).alias("labels"))
    labels = scratch.table(labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SEEDS))
    number, freq = vocabulary(terms, n, labels)
    if not len(freq):
        return spark.createDataFrame([], "doc_id bigint, subject string")
    scale = 1 / np.sqrt(freq)
    vectors = scratch.table(document_vectors(terms, number, labels))
    basis = singular_vectors(vectors, scale)
    first, second = centroids(vectors, basis, scale, len(subjects))
    sent = spark.sparkContext.broadcast((basis, scale, first, second, term_subjects(basis, first, second)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, by, one, two, owner = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = Sparse(batch, by)
            e = _unit(x.times(own))
            mentions = np.zeros((x.rows, len(subjects)))
            of = owner[x.cols]
            np.add.at(mentions, (np.repeat(np.arange(x.rows), x.lengths)[of >= 0], of[of >= 0]), x.tf[of >= 0])
            at, s = np.nonzero((np.maximum(e @ one.T, e @ two.T) >= LEAST_COSINE) & (mentions >= LEAST_MENTIONS))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array([subjects[i] for i in s.tolist()], pa.string())], ["doc_id", "subject"])

    return vectors.mapInArrow(assign, "doc_id bigint, subject string").distinct()
