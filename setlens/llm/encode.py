"""Token ids of whole texts by a public byte-level BPE.

Texts up to LIMIT code points are encoded where they are read. A longer one is never read by one task after the cut: it
is halved and halved again by code points into parts of at most LIMIT, wherever that falls, each part is encoded in
parallel as if it were a text of its own, and neighbours are joined pairwise, one level of the tree in each stage.

A join gives exactly what encoding both parts as one text would give. Its window starts at a border of pieces of the left
part that nothing behind the part can move (LOOKAHEAD), and grows into the right part until the pattern's pieces meet a
border of the right part; from there on both sides agree. A piece across the join that is long itself (text without any
break) is encoded by tokens: a growing window of tokens is encoded again until its first token is the left side's own and
its last token the right side's own. A BPE sequence is the encoding of its bytes exactly if every two neighbours are the
encoding of theirs, so agreement on both sides makes the join exact.

Defined cases: null and empty texts give an empty list; special tokens' strings are ordinary text; repeated rows and ids
give one row each; every row of the input gives one row, further columns are dropped.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setlens.shared import cut

LIMIT = 2_048  # code points encoded in one go
WINDOW = 4  # pieces or tokens on each side of a join in the first try
LOOKAHEAD = 8  # code points, more than the pattern looks at behind the end of a piece
KNOWN = 200_000  # pieces whose ids a task keeps at most
BATCH = 256  # parts handed on at once
HELD = 1_000_000  # code points of joined texts handed on at once


def default_vocabulary() -> tuple[str, str]:
    """Path of the ranks of byte_bpe_50k and its pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Part(NamedTuple):
    """A text with its encoding: the ids, and the code points and the number of ids of each piece of the pattern."""

    text: str
    ids: np.ndarray
    chars: np.ndarray
    counts: np.ndarray


class Encoder:
    """Encodes parts and joins neighbours.

    pieces: text -> its pieces, which follow each other without gap; encode: bytes of a piece -> ids; sizes: bytes of each id.
    """

    def __init__(self, pieces: Callable[[str], list[str]], encode: Callable[[bytes], list[int]], sizes: np.ndarray, limit: int = LIMIT):
        self.pieces, self.encode, self.sizes, self.limit = pieces, encode, sizes, limit
        self.known: dict[str, list[int]] = {}

    @classmethod
    @lru_cache(maxsize=4)
    def of(cls, path: str, pattern: str, limit: int = LIMIT) -> Encoder:
        """One for all tasks of a Python worker, so that what it knows stays."""
        import regex

        enc = encoding(path, pattern)
        sizes = np.zeros(enc.n_vocab, np.int64)
        for raw, t in enc._mergeable_ranks.items():
            sizes[t] = len(raw)
        return cls(regex.compile(pattern).findall, enc._encode_single_piece, sizes, limit)

    def piece(self, text: str) -> list[int]:
        ids = self.known.get(text)
        if ids is None:
            ids = self.encode(text.encode())
            if len(self.known) < KNOWN:
                self.known[text] = ids
        return ids

    def part(self, text: str) -> Part:
        found = self.pieces(text)
        ids = [self.piece(p) for p in found]
        return Part(text, _ints([t for x in ids for t in x]), _ints([len(p) for p in found]), _ints([len(x) for x in ids]))

    def join(self, a: Part, b: Part) -> Part:
        """The encoding of both texts as one."""
        if not a.text or not b.text:
            return a if a.text else b
        here = len(a.text)
        # borders of pieces in the joined text, both ends included
        a_at, b_at = _borders(a.chars), here + _borders(b.chars)
        first = max(0, int(np.searchsorted(a_at, here - LOOKAHEAD, "right")) - 1)  # this border stays whatever follows
        start = int(a_at[first])
        width = WINDOW
        while True:
            last = min(width, len(b.chars))
            end = int(b_at[last])
            found = self.pieces(a.text[start:] + b.text[: end - here])
            borders = start + _borders(_ints([len(p) for p in found]))
            # where the window does not reach the end, its last pieces have not seen enough
            reach = end if last == len(b.chars) else end - LOOKAHEAD
            met = borders[(borders >= here) & (borders <= reach) & np.isin(borders, b_at)]
            if len(met):
                break
            width *= 2
        stop = int(met[0])
        n, keep = int(np.searchsorted(borders, stop)), int(np.searchsorted(b_at, stop))
        a_tok, b_tok = _borders(a.counts), _borders(b.counts)
        new = [self._near(a, b, found[k], int(borders[k]), (a_at, a_tok), (b_at, b_tok)) for k in range(n)]
        return Part(
            a.text + b.text,
            np.concatenate([a.ids[: a_tok[first]], *map(_ints, new), b.ids[b_tok[keep] :]]),
            np.concatenate([a.chars[:first], _ints([len(p) for p in found[:n]]), b.chars[keep:]]),
            np.concatenate([a.counts[:first], _ints([len(x) for x in new]), b.counts[keep:]]),
        )

    def _near(self, a: Part, b: Part, piece: str, at: int, left: tuple, right: tuple) -> np.ndarray | list[int]:
        """The ids of a piece at the join; of a long one from what the parts know of its beginning and its end."""
        if len(piece) <= self.limit:
            return self.piece(piece)
        here, end = len(a.text), at + len(piece)
        head = tail = _ints([])
        (a_at, a_tok), (b_at, b_tok) = left, right
        k = int(np.searchsorted(a_at, at))
        if at < here and a_at[k] == at:  # the left part has a piece with this beginning
            head = self._fit(a.ids[a_tok[k] : a_tok[k + 1]], a.text[at : min(end, here)])
        k = int(np.searchsorted(b_at, end))
        if end > here and b_at[k] == end:  # the right part has a piece with this end
            tail = self._fit(b.ids[b_tok[k - 1] : b_tok[k]][::-1], b.text[max(at - here, 0) : end - here])[::-1]
        return join_ids(head, tail, self.sizes, self.encode, piece.encode())

    def _fit(self, ids: np.ndarray, text: str) -> np.ndarray:
        """The first ids, as many as have room in the bytes of text."""
        return ids[: int(np.searchsorted(np.cumsum(self.sizes[ids]), len(text.encode()), "right"))]


def _ints(x) -> np.ndarray:
    return np.asarray(x, np.int32)


def _borders(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths, dtype=np.int64)])


def join_ids(left: np.ndarray, right: np.ndarray, sizes: np.ndarray, encode: Callable[[bytes], list[int]], raw: bytes) -> np.ndarray:
    """The encoding of raw, of which left is that of its beginning and right that of its end.

    Bytes between the two are encoded with the window. sizes: bytes of each token id.
    """
    width = WINDOW
    while True:
        a, b = min(width, len(left)), min(width, len(right))
        start = int(sizes[left[: len(left) - a]].sum())
        end = len(raw) - int(sizes[right[b:]].sum())
        new = encode(raw[start:end])
        # a window that reaches an end of the piece needs no agreement there
        left_agrees = start == 0 or (new[0] == left[-a] and len(new) > 1)
        right_agrees = end == len(raw) or (new[-1] == right[b - 1] and len(new) > 1)
        if left_agrees and right_agrees:
            return np.concatenate([left[: len(left) - a], _ints(new), right[b:]])
        width *= 2


def halves(text: str, parts: int) -> list[str]:
    """A text halved and halved again into a power of two of parts, between any two code points."""
    edges = [len(text) * k // parts for k in range(parts + 1)]
    return [text[x:y] for x, y in zip(edges, edges[1:])]


def _frame(rows: list[tuple[int, object, int, Part]]) -> pd.DataFrame:
    out = [(row, id_, seq, p.text, p.ids.tobytes(), p.chars.tobytes(), p.counts.tobytes()) for row, id_, seq, p in rows]
    return pd.DataFrame(out, columns=["row", "id", "seq", "text", "ids", "chars", "counts"])


def tree_encode(texts: DataFrame, vocabulary: tuple[str, str], limit: int = LIMIT) -> DataFrame:
    """(id, ids: int32 numbers as bytes) of written texts (row, id, text, parts): row distinct, parts a power of two of each text."""
    path, pattern = vocabulary
    head = f"row bigint, id {texts.schema['id'].dataType.simpleString()}, seq int, text string"
    node = head + ", ids binary, chars binary, counts binary"

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row, id_, text, n in zip(pdf["row"], pdf["id"], pdf["text"], pdf["parts"]):
                parts = halves(text, n)
                for k in range(0, n, BATCH):
                    some = parts[k : k + BATCH]
                    yield pd.DataFrame({"row": row, "id": id_, "seq": range(k, k + len(some)), "text": some})

    def encode_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = Encoder.of(path, pattern, limit)
        for pdf in batches:
            yield _frame([(row, id_, seq, e.part(x)) for row, id_, seq, x in zip(pdf["row"], pdf["id"], pdf["seq"], pdf["text"])])

    def join_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by row and seq, and both of a pair to the same task."""
        e, held, out, size = Encoder.of(path, pattern, limit), None, [], 0
        for pdf in batches:
            for row, id_, seq, text, *packed in pdf.itertuples(index=False):
                part = Part(text, *(np.frombuffer(x, np.int32) for x in packed))
                if held is None:
                    held = part
                    continue
                out.append((row, id_, seq // 2, e.join(held, part)))
                held, size = None, size + len(out[-1][3].text)
                if size > HELD:
                    yield _frame(out)
                    out, size = [], 0
        yield _frame(out)

    nodes, before = None, 0
    # a text of 2^k parts enters k levels below the root, so that all take part in their own levels only; there are 31 at most
    for n in sorted((r["parts"] for r in texts.select("parts").distinct().collect()), reverse=True):
        for _ in range(before - n.bit_length() if before else 0):
            nodes = _pairs(nodes).mapInPandas(join_pairs, node)
        parts = texts.where(F.col("parts") == n).mapInPandas(cut_up, head)
        encoded = parts.repartition("row", "seq").mapInPandas(encode_parts, node)
        nodes, before = encoded if nodes is None else nodes.unionByName(encoded), n.bit_length()
    for _ in range(before - 1):
        nodes = _pairs(nodes).mapInPandas(join_pairs, node)
    return nodes.select("id", "ids") if nodes is not None else texts.select("id", F.lit(b"").alias("ids"))


def _pairs(nodes: DataFrame) -> DataFrame:
    return nodes.repartition("row", F.shiftright("seq", 1)).sortWithinPartitions("row", "seq")


def _long(rows: DataFrame, limit: int) -> DataFrame:
    """Written rows with a number of their own and the number of parts; equal ids must not run together."""
    bits = F.length(F.bin(F.ceil(F.length("text") / limit) - 1))
    return cut(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("parts", F.call_function("shiftleft", F.lit(1), bits)))


def encode_texts(
    docs: DataFrame, id_col: str, text_col: str, vocabulary: tuple[str, str] | None = None, limit: int = LIMIT
) -> DataFrame:
    """(id, ids): the token ids of each text as array<int>."""
    path, pattern = vocabulary or default_vocabulary()
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def short(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(path, pattern)
        for s in batches:
            yield s.map(enc.encode_ordinary)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def unpacked(ids: pd.Series) -> pd.Series:
        return ids.map(lambda raw: np.frombuffer(raw, np.int32))

    is_long = F.length("text") > limit
    joined = tree_encode(_long(texts.where(is_long), limit), (path, pattern), limit)
    return texts.where(~is_long).select("id", short("text").alias("ids")).unionByName(joined.select("id", unpacked("ids").alias("ids")))


def count_tokens(docs: DataFrame, text: Column, vocabulary: tuple[str, str] | None = None, limit: int = LIMIT) -> DataFrame:
    """docs with tokens: the number of token ids of each text, 0 for null and empty ones."""
    path, pattern = vocabulary or default_vocabulary()

    @F.pandas_udf(T.LongType())
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(path, pattern)
        for s in batches:
            yield s.map(lambda x: len(enc.encode_ordinary(x)) if x else 0).astype("int64")

    every = docs.select(F.struct(*docs.columns).alias("doc"), text.alias("text"))
    is_long = F.coalesce(F.length("text") > limit, F.lit(False))
    short = every.where(~is_long).select("doc", tokens("text").alias("tokens"))
    longs = _long(every.where(is_long), limit)
    counted = tree_encode(longs.select("row", F.col("row").alias("id"), "text", "parts"), (path, pattern), limit)
    counted = counted.select(F.col("id").alias("row"), (F.octet_length("ids") / 4).cast("bigint").alias("tokens"))
    return short.unionByName(longs.join(counted, "row").select("doc", "tokens")).select("doc.*", "tokens")
