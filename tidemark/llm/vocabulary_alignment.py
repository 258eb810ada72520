"""Which tokens of two vocabularies say the same bytes: groups, links and link counts over a corpus.

Both vocabularies cut the bytes of a space and the text. Where tokens of both end together a group ends; tokens whose
byte ranges overlap are linked. Most groups are one token of A and the token of B with the same bytes: for those an
identity map (id of A -> id of B) tells the pair from the id of A alone, so they are counted in vectors as long as the
vocabulary. Only the pairs of other groups are counted by a shuffle on the pair.

A text is cut into chunks where neither vocabulary can have a token across, before a space or line break that follows
something else. A task aligns the chunks that it has not met before, all of a batch at once, and keeps a bounded
number of them. Texts are read twice: once to count the pairs, once to score each document by the counts. The counts of
the most frequent pairs, a bounded number, travel to the documents; a document's other pairs meet theirs in a join.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import document_batches, tokenizer_path, write_table
from tidemark.llm.tokens import CHUNKS, UNSAFE, in_portions

PIECES_FILE = "piece_bpe_32k.model"
#: Pairs whose counts are carried to the documents: a bound on the broadcast, not on what is counted.
HEAD_PAIRS = 200_000
#: Chunks, and characters of them, that a worker keeps; pairs a task counts before it hands its counts on.
CHUNKS_KEPT, CHARS_KEPT, PAIRS_COUNTED = 600_000, 16_000_000, 500_000
#: Characters of texts that are aligned together.
CHARS_AT_ONCE = 1_000_000
#: Characters of new chunks that are encoded as one string.
JOINED_CHARS = 1_000
_SPACE = "\u2581"
#: Bits of an id of B in the code of a pair.
B_BITS = 24


def _code(a, b):
    return a << B_BITS | b


class Vocabularies:
    """Both vocabularies, the bytes of their tokens, and the identity map."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        special = {t.content for t in self.a.get_added_tokens_decoder().values() if t.special}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        #: Byte-level BPE writes each byte as a printable character: itself, or the next one from 256 on.
        back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            if token not in special:
                self.bytes_a[i] = bytes([back[c] for c in token])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        mute = [self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_unused(i) for i in range(len(pieces))]
        self.bytes_b = [b"" if mute[i] else bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        # of two ids with the same bytes, the piece: a byte token stands in only for what has no piece
        ids = {self.bytes_b[i]: i for i in sorted(range(len(pieces)), key=lambda i: not self.b.is_byte(i)) if self.bytes_b[i]}
        #: id of A -> id of B with the same bytes, or -1.
        self.identity = np.array([ids.get(x, -1) if x else -1 for x in self.bytes_a], np.int64)
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in own], np.int64) for own in (self.bytes_a, self.bytes_b))
        #: Whether chunks may be cut: no piece goes on across a space or a line break.
        self.cuts = not any(re.search(f"[^{_SPACE}]{_SPACE}|\n", p) for i, p in enumerate(pieces) if not mute[i] and not self.b.is_byte(i))
        #: A stop before white space and after a letter that no piece joins with a stop: a chunk of its own.
        joined = {p[k] for i, p in enumerate(pieces) if not mute[i] and not self.b.is_byte(i) for k in range(len(p) - 1) if p[k + 1] in ".,"}
        self.stops = re.compile(r"(?<=[^\W\d_" + re.escape("".join(sorted(c for c in joined if c.isalnum()))) + r"])([.,])(?=[ \n])")
        self.lone = self.b.piece_to_id(_SPACE)
        #: Each id in decimal behind each sign: id i behind sign k is entry k * top + i.
        self.top = max(len(self.bytes_a), len(self.bytes_b))
        self.shown = [sign + str(i) for sign in (",", ";", "|", "") for i in range(self.top)]

    def chunks(self, text: str | None) -> list[str]:
        """The stretches of a space and a text that neither vocabulary crosses; none of an empty text."""
        if not text:
            return []
        full = " " + text
        if not self.cuts or "\x00" in full or UNSAFE.search(full):
            return [full]
        return CHUNKS.findall(self.stops.sub("\x00\\1", full))

    def _encoded(self, strings: list[str]) -> list[tuple[np.ndarray, np.ndarray, bool]]:
        """Ids of A and of B of each string, and whether both spell it byte for byte."""
        a = [np.array(e.ids, np.int64) for e in self.a.encode_batch_fast(strings, add_special_tokens=False)]
        # B puts a space before a text: the string's own first one, or a token of its own before a line break
        b = self.b.encode([s[1:] if s[0] == " " else s if s[0] == "\n" else "\n" + s for s in strings], num_threads=1)
        b = [np.array([self.lone] if s == " " else ids if s[0] == " " else ids[1:] if s[0] == "\n" else ids[2:], np.int64) for s, ids in zip(strings, b, strict=True)]
        spells = lambda ids, own, data: b"" not in (parts := list(map(own.__getitem__, ids.tolist()))) and b"".join(parts) == data
        return [(x, y, spells(x, self.bytes_a, data := s.encode()) and spells(y, self.bytes_b, data)) for s, x, y in zip(strings, a, b, strict=True)]

    def encode(self, chunks: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """The chunks in an order of their own, ids of A and of B of all of them, and whether each is spelt byte for byte.

        Chunks that begin with white space and end in none are cut apart again by either vocabulary wherever they are laid together, so
        many are encoded as one string. The others, and those of a string that is not spelt, are encoded one by one;
        a chunk that is not spelt has no ids.
        """
        strings, held, size, alone = [], [], 0, []
        for c in chunks:
            if c[-1].isspace() or c[0] not in " \n":
                alone.append(c)
                continue
            held.append(c)
            size += len(c)
            if size >= JOINED_CHARS:
                strings.append(held)
                held, size = [], 0
        strings += [held] if held else []
        order, a, b = [], [], []
        for own, (x, y, spelt) in zip(strings, self._encoded(["".join(h) for h in strings]) if strings else [], strict=True):
            if spelt:
                order += own
                a.append(x)
                b.append(y)
            else:
                alone += own
        spelt_all = [True] * len(order)
        for c, (x, y, spelt) in zip(alone, self._encoded(alone) if alone else [], strict=True):
            order.append(c)
            spelt_all.append(spelt)
            if spelt:
                a.append(x)
                b.append(y)
        flat = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
        return order, flat(a), flat(b), np.array(spelt_all, bool)


@functools.lru_cache(maxsize=1)
def vocabularies(path_a: str, path_b: str) -> Vocabularies:
    """One per worker process."""
    return Vocabularies(path_a, path_b)


@functools.lru_cache(maxsize=1)
def kept_chunks(path_a: str, path_b: str) -> Chunks:
    """One per worker process, so that what it holds outlives a task."""
    return Chunks(vocabularies(path_a, path_b))


class Chunks:
    """Chunks that a task has met, by number: their sizes, the codes of their links and the text of their groups.

    Links lie one after another: those of chunk i from ``first[i]`` to ``first[i + 1]``; ``exact`` marks the ones that
    the identity map maps. ``spelt`` is false for a chunk that either vocabulary does not spell byte for byte. ``sums``
    are, for each chunk, the sums over its links of being best, of the counts, and of being without a carried count.
    """

    def __init__(self, v: Vocabularies):
        self.v, self.score = v, None
        self.clear()

    def scored_by(self, score: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]] | None) -> None:
        """Take counts and bests (-1 where none is carried) of links from ``score``, for chunks held and to come."""
        self.score = score
        self.sums, self.rest = np.zeros((3, 0), np.int64), np.zeros(0, bool)
        if score is not None:
            self._sum(0)

    def _sum(self, since: int) -> None:
        codes, n = self.codes[self.first[since] :], self.sizes[3][since:]
        counts, best = self.score(codes)
        of = np.repeat(np.arange(len(n)), n)
        sums = np.zeros((3, len(n)), np.int64)  # bincount adds doubles, which round sums beyond 2^53
        np.add.at(sums[1], of, np.maximum(counts, 0))
        sums[0], sums[2] = np.bincount(of[best > 0], minlength=len(n)), np.bincount(of[counts < 0], minlength=len(n))
        self.sums, self.rest = np.concatenate([self.sums, sums], axis=1), np.concatenate([self.rest, counts < 0])

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.chars = 0
        self.sizes = np.zeros((4, 0), np.int32)  # tokens of A, of B, groups, links
        self.spelt = np.zeros(0, bool)
        self.first = np.zeros(1, np.int64)
        self.codes, self.exact = np.zeros(0, np.int64), np.zeros(0, bool)
        self.groups: list[str] = []
        self.sums, self.rest = np.zeros((3, 0), np.int64), np.zeros(0, bool)

    def full(self) -> bool:
        return len(self.numbers) > CHUNKS_KEPT or self.chars > CHARS_KEPT

    def number(self, chunks: list[str]) -> np.ndarray:
        """The numbers of chunks; those not met before are aligned."""
        new = list(set(chunks).difference(self.numbers))
        if new:
            self._add(new)
        return np.fromiter(map(self.numbers.__getitem__, chunks), np.int64, len(chunks))

    def _add(self, new: list[str]) -> None:
        v = self.v
        new, a, b, spelt = v.encode(new)
        ends = np.cumsum(np.fromiter((len(c.encode()) for c in new), np.int64, len(new)) * spelt)
        end_a, end_b = np.cumsum(v.sizes_a[a]), np.cumsum(v.sizes_b[b])
        n_a, n_b = (np.diff(np.searchsorted(end, ends, "right"), prepend=0) for end in (end_a, end_b))
        common = np.intersect1d(end_a, end_b, assume_unique=True)  # where groups end
        cuts = np.union1d(end_a, end_b)  # each stretch between cuts is the overlap of one token of A with one of B
        at_a, at_b = np.searchsorted(end_a, cuts), np.searchsorted(end_b, cuts)
        group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        one = (np.bincount(group_a, minlength=len(common)) == 1) & (np.bincount(group_b, minlength=len(common)) == 1)
        exact = one[group_a[at_a]] & (v.identity[a[at_a]] == b[at_b])
        per_chunk = lambda at: np.bincount(np.searchsorted(ends, at), minlength=len(new))
        sizes = np.stack([n_a, n_b, per_chunk(common), per_chunk(cuts)]).astype(np.int32)
        codes = _code(a[at_a], b[at_b])
        self.groups += self._texts(a, b, group_a, group_b, sizes)
        self.numbers.update(zip(new, range(len(self.numbers), len(self.numbers) + len(new)), strict=True))
        self.chars += sum(map(len, new))
        first = self.first[-1] + np.cumsum(sizes[3], dtype=np.int64)
        self.sizes, self.spelt = np.concatenate([self.sizes, sizes], axis=1), np.concatenate([self.spelt, spelt])
        self.codes, self.exact, self.first = np.concatenate([self.codes, codes]), np.concatenate([self.exact, exact]), np.concatenate([self.first, first])
        if self.score is not None:
            self._sum(len(self.spelt) - len(new))

    def _texts(self, a, b, group_a, group_b, sizes) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each chunk."""
        place = np.concatenate([2 * group_a, 2 * group_b + 1])
        order = np.argsort(place, kind="stable")
        place, ids = place[order], np.concatenate([a, b])[order]
        fresh = np.ones(len(place), bool)
        fresh[1:] = place[1:] != place[:-1]
        sign = np.where(fresh, 1 + place % 2, 0)
        bounds = np.concatenate([[0], np.cumsum(sizes[0] + sizes[1], dtype=np.int64)])
        sign[bounds[:-1][bounds[:-1] < len(sign)]] = 3  # the first of a chunk
        parts = list(map(self.v.shown.__getitem__, (sign * self.v.top + ids).tolist()))
        return ["".join(parts[s:e]) for s, e in itertools.pairwise(bounds.tolist())]

    def links_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the links of chunks, one after another: the place in ``numbers`` and the place in ``codes``."""
        n = self.sizes[3][numbers].astype(np.int64)
        of = np.repeat(np.arange(len(numbers)), n)
        return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[numbers], n)


def _portions(batches: Iterator[pa.RecordBatch], v: Vocabularies, text: int):
    """(columns, chunks of all texts, number of chunks of each text), about CHARS_AT_ONCE of text at a time."""
    for rows in batches:
        for own in in_portions(rows, text, CHARS_AT_ONCE):
            chunks = list(map(v.chunks, own[text]))
            yield own, [c for x in chunks for c in x], np.fromiter(map(len, chunks), np.int64, len(chunks))


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sum of the counts of each."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[heads], np.add.reduceat(counts, heads) if len(keys) else counts


def count_pairs(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(a, b, exact, n): links of each pair of ids, from one-to-one groups of the identity map and from all others.

    A task adds up the first kind in a vector over the ids of A and hands on what is not zero; the rows of the second
    kind are the only ones keyed by a pair.
    """

    def worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, store = vocabularies(path_a, path_b), kept_chunks(path_a, path_b)
        store.scored_by(None)
        vector = np.zeros(len(v.bytes_a), np.int64)
        uses = np.zeros(0, np.int64)
        pairs = (np.zeros(0, np.int64), np.zeros(0, np.int64))

        def batch(codes, exact, n) -> pa.RecordBatch:
            ids = [pa.array((codes >> B_BITS).astype(np.int32)), pa.array((codes & (1 << B_BITS) - 1).astype(np.int32))]
            return pa.RecordBatch.from_arrays([*ids, pa.array(np.full(len(codes), exact)), pa.array(n)], ["a", "b", "exact", "n"])

        def add_up() -> None:
            nonlocal pairs, uses
            n = np.repeat(uses, store.sizes[3][: len(uses)])
            codes, exact = store.codes[: len(n)], store.exact[: len(n)]
            np.add.at(vector, codes[exact] >> B_BITS, n[exact])
            other = ~exact & (n > 0)
            pairs = _added(np.concatenate([pairs[0], codes[other]]), np.concatenate([pairs[1], n[other]]))
            uses = np.zeros(0, np.int64)

        for _, chunks, lengths in _portions(batches, v, 0):
            numbers = store.number(chunks)
            of = np.repeat(np.arange(len(lengths)), lengths)
            unspelt = np.bincount(of[~store.spelt[numbers]], minlength=len(lengths)) > 0
            uses = np.concatenate([uses, np.zeros(len(store.spelt) - len(uses), np.int64)])
            uses += np.bincount(numbers[~unspelt[of]], minlength=len(uses))
            if store.full():
                add_up()
                store.clear()
                if len(pairs[0]) >= PAIRS_COUNTED:
                    yield batch(pairs[0], False, pairs[1])
                    pairs = (pairs[0][:0], pairs[1][:0])
        add_up()
        if len(pairs[0]):
            yield batch(pairs[0], False, pairs[1])
        ones = np.flatnonzero(vector)
        if len(ones):
            yield batch(_code(ones, v.identity[ones]), True, vector[ones])

    return docs.select("text").mapInArrow(worker, "a int, b int, exact boolean, n long")


def pair_counts(counted: DataFrame) -> DataFrame:
    """(a, b, n, best): each linked pair, its links over the corpus, and whether no pair of its b has more."""
    ones = counted.where("exact").groupBy("a").agg(F.first("b").alias("b"), F.sum("n").alias("n"))  # at most the vocabulary of A
    irregular = counted.where("not exact").groupBy("a", "b").agg(F.sum("n").alias("n"))
    pairs = ones.unionByName(irregular).groupBy("a", "b").agg(F.sum("n").alias("n"))
    most = pairs.groupBy("b").agg(F.max("n").alias("most"))  # at most the vocabulary of B
    return pairs.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


SCORED = "key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string, a int, b int, k long"


def _score(docs: DataFrame, head: tuple[np.ndarray, np.ndarray, np.ndarray], path_a: str, path_b: str, with_groups: bool) -> DataFrame:
    """A row for each document with its sums over head pairs, and one for each other pair that it holds (``a`` set)."""
    sent = docs.sparkSession.sparkContext.broadcast(head)  # HEAD_PAIRS rows at most
    kinds = [(f.split()[0], {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[f.split()[1]]) for f in SCORED.split(", ")]

    def worker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabularies(path_a, path_b)
        known, counts, best = sent.value

        def score(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if not len(known):
                return np.full(len(codes), -1), np.full(len(codes), -1)
            at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
            found = known[at] == codes
            return np.where(found, counts[at], -1), np.where(found, best[at], -1)

        store = kept_chunks(path_a, path_b)
        store.scored_by(score)
        key = TaskContext.get().partitionId() << 36

        def batch(n: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(columns[c], kind) if c in columns else pa.nulls(n, kind) for c, kind in kinds], [c for c, _ in kinds])

        for (doc_ids, _), chunks, lengths in _portions(batches, v, 1):
            numbers = store.number(chunks)
            n = len(lengths)
            of = np.repeat(np.arange(n), lengths)
            unspelt = np.bincount(of[~store.spelt[numbers]], minlength=n) > 0
            keep = ~unspelt[of]
            numbers, of = numbers[keep], of[keep]
            bounds = np.searchsorted(of, np.arange(n + 1))
            totals = [np.diff(np.concatenate([[0], np.cumsum(x[numbers], dtype=np.int64)])[bounds]) for x in (*store.sizes, *store.sums[:2])]
            texts = [";".join(map(store.groups.__getitem__, numbers[s:e].tolist())) for s, e in itertools.pairwise(bounds.tolist())]
            own = dict(zip(("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"), totals, strict=True))
            sha = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts]
            yield batch(n, key=np.arange(key, key + n), doc_id=doc_ids, **own, groups_sha256=sha, **({"groups": texts} if with_groups else {}))
            rest = store.sums[2][numbers] > 0
            at, link = store.links_of(numbers[rest])
            link, row = link[store.rest[link]], of[rest][at[store.rest[link]]]
            codes = store.codes[link]
            order = np.lexsort((codes, row))
            codes, row = codes[order], row[order]
            heads = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]) | (row[1:] != row[:-1]))) if len(codes) else np.zeros(0, np.int64)
            if len(heads):
                times = np.diff(np.append(heads, len(codes)))
                yield batch(len(heads), key=key + row[heads], a=(codes[heads] >> B_BITS).astype(np.int32), b=(codes[heads] & (1 << B_BITS) - 1).astype(np.int32), k=times)
            key += n
            if store.full():
                store.clear()

    return docs.select("doc_id", "text").mapInArrow(worker, SCORED)


def align(docs: DataFrame, tokenizer: str | None = None, pieces: str | None = None, with_groups: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and groups).

    A null or empty text, and one that either vocabulary does not spell byte for byte, has no tokens: zeros and an
    empty groups_sha256. Pairs with equal counts for one id of B are all best. Repeated rows count, and are returned, as often as
    they come; a null doc_id is carried; very long texts are aligned whole; an empty table gives no rows; other columns
    are ignored, whatever their names. ``with_groups`` adds the groups themselves, as ``a1,a2|b1;a3|b2,b3``.
    """
    path_a, path_b = tokenizer or tokenizer_path(), pieces or tokenizer_path(PIECES_FILE)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    document_batches(docs.sparkSession)
    counted = write_table(count_pairs(rows, path_a, path_b), "pairs-counted")
    pairs = write_table(pair_counts(counted), "pairs")
    top = pairs.orderBy(F.desc("n"), "a", "b").limit(HEAD_PAIRS).toArrow()
    a, b, n, best = (top.column(c).to_numpy().astype(np.int64) for c in ("a", "b", "n", "best"))
    order = np.argsort(_code(a, b))
    head = (_code(a, b)[order], n[order], best[order])
    linked = write_table(_score(rows, head, path_a, path_b, with_groups), "linked")
    rest = linked.where("a is not null").select("key", "a", "b", "k").join(pairs, ["a", "b"])
    more = rest.groupBy("key").agg(F.sum(F.col("k") * F.col("n")).alias("__sum"), F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("__best"))
    out = linked.where("a is null").join(more, "key", "left")
    return out.select(
        "doc_id",
        *("n_a", "n_b", "n_groups", "n_links"),
        (F.col("n_best") + F.coalesce("__best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("__sum", F.lit(0))).alias("count_sum"),
        "groups_sha256",
        *(["groups"] if with_groups else []),
    )
