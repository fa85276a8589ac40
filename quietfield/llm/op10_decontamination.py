"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items are dealt into parts of about MAX_WORDS words, a suffix automaton is built of each
by one task, and frozen into arrays (about 60 bytes a word).  The arrays are broadcast: a
Python worker holds them once, whatever number of tasks it runs.  Of a document only runs
whose every gram of a few words occurs in the benchmark (one bitmap for all parts) are
streamed through the automata, which track the longest match that ends at each word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as k
from .repeats import gather
from .runtime import named, table

WINDOW = 13
COVERAGE = 20  # contaminated when COVERAGE * n_hit >= n_words
MAX_WORDS = 500_000  # benchmark words of one automaton: 360 MB while it is built
GRAM = 3  # words of the grams looked for first, fewer where an item has fewer
BITS_PER_GRAM = 16
LIMIT_MB = 64  # benchmark text that may be sent to the tasks
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x41:0x5B] = IS_WORD[0x61:0x7B] = True
IS_WORD[0x80:] = True
NO_ITEM = -1  # in place of a null item id: its windows hit words, but it is in no list


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, begin and end of every normalised word, and the n+1 bounds of the documents."""
    low = k.LOWER[raw]
    b, e, first = k.words(low, offsets, IS_WORD)
    return k.word_hashes(low, b, e), b, e, first


class Automaton:
    """Generalised suffix automaton over word numbers.

    Every state stands for a set of word strings with the same occurrences; `long` is
    the length of its longest, `link` its longest suffix with more occurrences.
    """

    def __init__(self, items: list[tuple[int, np.ndarray]], window: int):
        """items: (number of the item, hashes of its words)."""
        self.words = np.unique(np.concatenate([w for _, w in items]))
        self.next: list[dict[int, int]] = [{}]
        self.link, self.long = [-1], [0]
        paths: list[tuple[int, list[int]]] = []
        for item, w in items:
            seq = np.searchsorted(self.words, w).tolist()
            last = 0
            for c in seq:
                last = self._add(last, c)
            paths.append((item, seq))
        # walk each item again: the windows it holds, or all of it where it is shorter
        self.own: set[tuple[int, int]] = set()
        self.whole: set[tuple[int, int, int]] = set()
        for item, seq in paths:
            state = length = 0
            for n, c in enumerate(seq):
                state, length = self.step(state, length, c)
                if n >= window - 1:
                    self.own.add((self._at(state, window), item))
            if len(seq) < window:
                self.whole.add((self._at(state, len(seq)), len(seq), item))

    def _add(self, last: int, c: int) -> int:
        nxt, link, long = self.next, self.link, self.long
        if c in nxt[last]:
            q = nxt[last][c]
            if long[q] == long[last] + 1:
                return q
            return self._split(last, c, q)
        cur = len(nxt)
        nxt.append({})
        long.append(long[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if long[q] == long[p] + 1 else self._split(p, c, q)
        return cur

    def _split(self, p: int, c: int, q: int) -> int:
        nxt, link, long = self.next, self.link, self.long
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        long.append(long[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def step(self, state: int, length: int, c: int) -> tuple[int, int]:
        """State and length of the longest match that ends with the next word."""
        while c not in self.next[state]:
            state = self.link[state]
            if state < 0:
                return 0, 0
            length = self.long[state]
        return self.next[state][c], length + 1

    def _at(self, state: int, length: int) -> int:
        """The state of the last `length` words of what is matched."""
        while self.link[state] >= 0 and self.long[self.link[state]] >= length:
            state = self.link[state]
        return state

    def frozen(self) -> dict[str, np.ndarray]:
        """Arrays that Frozen reads: edges ascending by (state, word), items by state."""
        sizes = np.array([len(x) for x in self.next], np.int64)
        word = np.fromiter((c for x in self.next for c in x), np.uint64, int(sizes.sum()))
        target = np.fromiter((t for x in self.next for t in x.values()), np.int32, int(sizes.sum()))
        edge = (np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes) << np.uint64(32)) | word
        order = np.argsort(edge)
        arrays = {"words": self.words, "edge": edge[order], "target": target[order], "link": np.array(self.link, np.int32), "long": np.array(self.long, np.int32)}
        for name, rows, width in (("own", self.own, 2), ("whole", self.whole, 3)):
            found = np.array(sorted(rows), np.int32).reshape(-1, width)
            arrays[f"{name}_at"] = np.searchsorted(np.ascontiguousarray(found[:, 0]), np.arange(len(sizes) + 1)).astype(np.int32)
            for n, part in enumerate(("item", "size")[: width - 1]):
                arrays[f"{name}_{part}"] = np.ascontiguousarray(found[:, width - 1 - n])
        # nearest state on the way to the root that ends a short item
        ends, short = np.diff(arrays["whole_at"]) > 0, np.full(len(sizes), -1, np.int32)
        for s in np.argsort(self.long, kind="stable").tolist():
            short[s] = s if ends[s] else (short[self.link[s]] if self.link[s] >= 0 else -1)
        return arrays | {"short": short}


class Frozen:
    """An automaton in arrays."""

    def __init__(self, arrays: dict[str, np.ndarray], window: int):
        self.words, self.edge, self.target = arrays["words"], arrays["edge"], arrays["target"]
        for name in ("link", "long", "short", "own_at", "own_item", "whole_at", "whole_item", "whole_size"):
            setattr(self, name, memoryview(arrays[name]))  # single values come quickest so
        self.window = window
        self.known: dict[int, int] = {}

    def _next(self, state: int, c: int) -> int:
        key = state << 32 | c
        to = self.known.get(key)
        if to is None:
            at = int(np.searchsorted(self.edge, np.uint64(key)))
            to = int(self.target[at]) if at < len(self.edge) and int(self.edge[at]) == key else -1
            if len(self.known) >= 1 << 15:
                self.known.clear()
            self.known[key] = to
        return to

    def scan(self, tok: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans [begin, end) of the windows in a run of words, and the numbers of the items they are from."""
        at = np.minimum(np.searchsorted(self.words, tok), len(self.words) - 1)
        codes = np.where(self.words[at] == tok, at, -1).tolist()
        spans, found, done = [], set(), set()
        state = length = 0
        for n, c in enumerate(codes):
            to = self._next(state, c) if c >= 0 else -1
            while to < 0 and c >= 0 and state:
                state = self.link[state]
                length = self.long[state]
                to = self._next(state, c)
            if to < 0:
                state = length = 0
                continue
            state, length = to, length + 1
            if length >= self.window:
                spans.append((n + 1 - self.window, n + 1))
                s = state
                while self.link[s] >= 0 and self.long[self.link[s]] >= self.window:
                    s = self.link[s]
                if s not in done:
                    done.add(s)
                    found.update(self.own_item[self.own_at[s] : self.own_at[s + 1]])
            s = self.short[state]
            while s >= 0:
                for x in range(self.whole_at[s], self.whole_at[s + 1]):
                    if self.whole_size[x] <= length:
                        spans.append((n + 1 - self.whole_size[x], n + 1))
                        found.add(self.whole_item[x])
                s = self.short[self.link[s]] if self.link[s] >= 0 else -1
        return spans, found


def _items(window: int, max_words: int):
    """Rows (id, text) to pieces (id, words): an item of more than max_words words in pieces that share a window less one word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = k.text_buffers(batch.column(1))
            for i, id_ in enumerate(batch.column(0).to_pylist()):
                part = raw[offsets[i] : offsets[i + 1]]
                w = tokens(part, np.array([0, len(part)]))[0].view(np.int64)
                starts = range(0, max(1, len(w) - window + 1), max_words) if len(w) else ()
                pieces = [w[s : s + max_words + window - 1] for s in starts]
                if pieces:
                    yield pa.RecordBatch.from_arrays([pa.array([id_] * len(pieces), pa.int64()), pa.array(pieces, pa.list_(pa.int64()))], names=["id", "words"])

    return run


def _build(window: int):
    """Pieces of each part to its frozen automaton, a row with the arrays as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = gather(batches)
        if t is None:
            return
        names = np.array([NO_ITEM if x is None else x for x in t["id"].to_pylist()], np.int64)
        lists = t["words"].combine_chunks()
        bounds, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(k.U64)
        part = t["part"].to_numpy()
        for p in np.unique(part).tolist():
            own = np.flatnonzero(part == p)
            ids, number = np.unique(names[own], return_inverse=True)
            arrays = Automaton([(int(n), flat[bounds[x] : bounds[x + 1]]) for n, x in zip(number, own, strict=True)], window).frozen() | {"ids": ids}
            yield pa.RecordBatch.from_arrays([pa.array([p] * len(arrays), pa.int32()), pa.array(list(arrays)), pa.array([x.dtype.str for x in arrays.values()]), pa.array([np.ascontiguousarray(x).tobytes() for x in arrays.values()], pa.binary())], names=["part", "name", "kind", "body"])

    return run


class Benchmark:
    """The automata of a benchmark and the bitmap of its grams, broadcast."""

    def __init__(self, benchmark: DataFrame, window: int, max_words: int = MAX_WORDS, limit_mb: int = LIMIT_MB):
        """Raises if the texts are more than limit_mb: a bound that is checked."""
        rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        if size > limit_mb << 20:
            raise ValueError(f"the benchmark has {size >> 20} MB; its automata are sent to every worker, {limit_mb} MB at most: run its parts one after another")
        pieces = table(rows.mapInArrow(_items(window, max_words), "id long, words array<long>"), "items")
        total, least = pieces.agg(F.sum(F.size("words")), F.min(F.size("words"))).first()
        parts = -(-(total or 0) // max_words) or 1
        self.window, self.least = window, min(window, least or window)
        self.gram = min(GRAM, self.least)
        dealt = pieces.withColumn("part", F.pmod(F.xxhash64("id", "words"), F.lit(parts)).cast("int")).repartition(parts, "part")
        built = table(dealt.mapInArrow(_build(window), "part int, name string, kind string, body binary"), "automata")
        automata: dict[int, dict[str, np.ndarray]] = {}
        for r in built.toLocalIterator():
            automata.setdefault(r["part"], {})[r["name"]] = np.frombuffer(bytes(r["body"]), dtype=r["kind"])
        bits = max(1 << 16, 1 << ((total or 1) * BITS_PER_GRAM - 1).bit_length())
        bitmap = np.zeros(bits // 8, np.uint8)
        for r in pieces.select("words").toLocalIterator():  # limit_mb of text at most
            g = self._places(np.array(r["words"], np.int64).view(k.U64), bits)
            np.bitwise_or.at(bitmap, g >> 3, (1 << (g & 7)).astype(np.uint8))
        value = (bitmap, [automata[p] for p in sorted(automata)])
        self.bytes = bitmap.nbytes + sum(x.nbytes for a in value[1] for x in a.values())
        self.sent = benchmark.sparkSession.sparkContext.broadcast(value)

    def __getstate__(self) -> dict:
        return self.__dict__

    def _places(self, tok: np.ndarray, bits: int) -> np.ndarray:
        """Bits of the grams that begin at each word."""
        at = np.arange(max(0, len(tok) - self.gram + 1))
        return (k.joined(tok, at, self.gram) & k.U64(bits - 1)).astype(np.int64)

    def runs(self, tok: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of words, not across documents, whose every gram may be in the benchmark."""
        bitmap = self.sent.value[0]
        g = self._places(tok, 8 * len(bitmap))
        starts = np.zeros(len(tok), dtype=bool)
        starts[: len(g)] = (bitmap[g >> 3] >> (g & 7).astype(np.uint8)) & 1 == 1
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        starts[: len(g)] &= doc[: len(g)] == doc[self.gram - 1 :][: len(g)]
        b, e = k.runs(starts, first)
        e = e + self.gram - 1
        long = e - b >= self.least
        return b[long], e[long]

    def automata(self) -> list[tuple[Frozen, np.ndarray]]:
        return [(Frozen(a, self.window), a["ids"]) for a in self.sent.value[1]]


def _match(bench: Benchmark, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = bench.automata()
        for batch in batches:
            raw, offsets = k.text_buffers(batch.column(1))
            n_docs = len(offsets) - 1
            n_words, n_hit = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
            found: list[set[int]] = [set() for _ in range(n_docs)]
            kept = [None] * n_docs
            for i, j in k.doc_chunks(offsets):
                part = raw[offsets[i] : offsets[j]]
                tok, wb, we, first = tokens(part, offsets[i : j + 1] - offsets[i])
                hit = np.zeros(len(tok), dtype=bool)
                n_words[i:j] = np.diff(first)
                for x, y in zip(*(v.tolist() for v in bench.runs(tok, first)), strict=True):
                    for auto, ids in automata:
                        spans, items = auto.scan(tok[x:y])
                        if spans:
                            for p, q in spans:
                                hit[x + p : x + q] = True
                            found[i + int(np.searchsorted(first, x, side="right")) - 1] |= set(ids[list(items)].tolist())
                owner = np.repeat(np.arange(j - i), np.diff(first))
                n_hit[i:j] = np.bincount(owner[hit], minlength=j - i)
                if with_text:
                    base = offsets[i]
                    for d in np.unique(owner[hit]).tolist():
                        own = slice(first[d], first[d + 1])
                        body, pieces, last = raw[offsets[i + d] : offsets[i + d + 1]].tobytes(), [], 0
                        for p, q in zip(*k.runs(hit[own], np.zeros(1, np.int64)), strict=True):
                            pieces.append(body[last : wb[own][p] + base - offsets[i + d]])
                            last = we[own][q - 1] + base - offsets[i + d]
                        kept[i + d] = b"".join([*pieces, body[last:]]).decode()
            dirty = (n_hit > 0) & (COVERAGE * n_hit >= n_words)
            lists = [sorted(map(str, x - {NO_ITEM})) for x in found]
            arrays = [batch.column(0), pa.array(n_words), pa.array(n_hit), pa.array([len(x) for x in lists], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in lists]), pa.array(dirty)]
            names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
            if with_text:
                arrays.append(pa.array(kept, pa.string()))
                names.append("cut_text")
            yield pa.RecordBatch.from_arrays(arrays + [batch.column(c) for c in range(2, batch.num_columns)], names=names + batch.schema.names[2:])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, max_words: int = MAX_WORDS) -> DataFrame:
    """Per document: words, words inside benchmark windows, items hit, and the verdict.

    Words are runs of ASCII letters and digits and of all non-ASCII characters, A-Z
    lower-cased.  A window is `window` consecutive words of an item; an item of fewer
    words, but not none, is one window.  Every window that ends where the automaton's
    longest match does marks its words.  with_text adds cut_text, the text without the
    words hit (null where nothing is hit).  contaminated: some word is hit and
    COVERAGE * n_hit >= n_words.  Null or blank texts have no words; items without a
    text are skipped; those without an id hit words but are in no list; an empty benchmark hits nothing; null and repeated
    document ids are kept as they are, a row for a row; other columns are not looked at.
    """
    bench = Benchmark(benchmark, window, max_words)
    extra = ", cut_text string" if with_text else ""
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_match(bench, with_text), "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean" + extra)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without contaminated documents; words hit in the others are cut from text, its length in n_chars."""
    names = docs.columns
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *[named(c).alias(f"_c{n}") for n, c in enumerate(names) if c != "text"])
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[2:]]
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, cut_text string, text string"
    run = _match(Benchmark(benchmark, window), True)

    def with_text(batches):
        for out, text in _paired(run, batches):
            yield pa.RecordBatch.from_arrays([*out.columns[:7], text, *out.columns[7:]], names=[*out.schema.names[:7], "text", *out.schema.names[7:]])

    rows = own.mapInArrow(with_text, ", ".join([schema, *kept])).where("not contaminated")
    cols = []
    for n, c in enumerate(names):
        if c == "text":
            cols.append(F.coalesce("cut_text", "text").alias(c))
        elif c == "n_chars":
            cols.append(F.when(F.col("cut_text").isNotNull(), F.length("cut_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(f"_c{n}")).alias(c))
        else:
            cols.append(F.col(f"_c{n}").alias(c))
    return rows.select(*cols)


def _paired(run, batches):
    """Each result of run with the text column of its batch."""
    for batch in batches:
        for out in run(iter([batch])):
            yield out, batch.column(1)


def op10_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
tests AS (SELECT item_id, row_number() OVER () AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_words AS (SELECT item_id, item, least(len(w), 13) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM tests),
item_grams AS (SELECT item_id, n, list(word) OVER (PARTITION BY item ORDER BY p ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS g FROM item_words),
windows AS (SELECT DISTINCT item_id, n, array_to_string(g, ' ') AS g FROM item_grams WHERE len(g) = n),
sizes AS (SELECT DISTINCT n FROM windows),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM docs),
grams AS (SELECT doc_id, p, list(word) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS g FROM words),
found AS (SELECT DISTINCT x.doc_id, x.p, x.n, windows.item_id FROM (SELECT doc_id, p, n, array_to_string(g[1:n], ' ') AS g FROM grams JOIN sizes ON len(g) >= n) x JOIN windows ON x.n = windows.n AND x.g = windows.g),
hits AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""
