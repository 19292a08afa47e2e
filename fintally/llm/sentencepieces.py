"""SentencePiece encoding and decoding with a merge-type (BPE) vocabulary.

The encoder keeps an agenda of adjacent symbol pairs, ordered by the score of the piece they form (ties: leftmost
first), and merges the best pair until no pair forms a piece. Pieces never hold a word mark after another
character, so no merge crosses the start of a word: text is cut before each run of marks and the symbols of a cut
are kept in a bounded memo. Each Arrow batch is checked against the sentencepiece library: every cut that is new to the
memo, and one whole text; a difference is an error.

Cases: a null or empty text has only the begin and end ids and decodes to the empty text; any text, of any length,
is encoded whole; repeated rows give repeated results; extra columns are kept, and columns named as the results are
replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from fintally.llm.common import slices, table

MARK = "▁"
#: Characters of the cuts that one worker's memo holds; it is emptied when over, which bounds memory and changes no result.
MEMO_CHARS = 5_000_000
#: Bytes of texts that are cut at once: their words, as Python strings, take several times that.
TEXT_BYTES = 1 << 20
#: Cuts below this length share the rounds of one array agenda; longer ones have a heap each.
SHORT_CHARS = 128
NO_PIECE = 1 << 30


class MergeVocabulary:
    """Agenda encoder over the pieces and scores of a merge-type model with byte fallback."""

    def __init__(self, model_file: str):
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = lib.get_piece_size()
        plain = [i for i in range(size) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
        self.ids = {lib.id_to_piece(i): i for i in plain}
        self.score = {lib.id_to_piece(i): lib.get_score(i) for i in plain}
        self.byte = {int(lib.id_to_piece(i)[3:5], 16): i for i in range(size) if lib.is_byte(i)}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("the vocabulary has pieces across words; cuts before word marks would not be exact")
        self.size = size
        order = {v: r for r, v in enumerate(sorted(set(self.score.values()), reverse=True))}
        merges = sorted(((self.ids[a] << 21) | self.ids[b], order[self.score[p]], i) for p, i in self.ids.items() for k in range(1, len(p)) if (a := p[:k]) in self.ids and (b := p[k:]) in self.ids)
        self.pair_key, self.pair_rank, self.pair_id = (np.array(x, np.int64) for x in zip(*merges, strict=True))
        self.char_id = np.arange(0x110000, dtype=np.int64) + size  # a character without a piece keeps its code point
        for p, i in self.ids.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        self.cuts = re.compile(f"{MARK}+[^{MARK}]*")
        self.memo: dict[str, bytes] = {}  # a cut without its first mark -> its ids, little-endian
        self.memo_chars = 0
        self.begin, self.end = (struct.pack("<I", i) for i in (lib.bos_id(), lib.eos_id()))

    def rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of the piece that each pair of symbols forms (NO_PIECE where none) and its id."""
        key = (left << 21) | right
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        found = self.pair_key[at] == key
        return np.where(found, self.pair_rank[at], NO_PIECE), self.pair_id[at]

    def encode_short(self, cuts: list[str]) -> list[bytes]:
        """The ids of many short cuts. Every cut has its own agenda; each round merges the best pair of every cut."""
        lengths = np.fromiter(map(len, cuts), np.int64, len(cuts))
        symbol = self.char_id[np.frombuffer("".join(cuts).encode("utf-32-le"), np.uint32)]
        cut = np.repeat(np.arange(len(cuts)), lengths)
        done_symbols, done_cuts = [], []
        last = np.append(cut[1:] != cut[:-1], True)
        rank, made = self.rank(symbol, np.append(symbol[1:], 0))
        rank[last] = NO_PIECE
        while len(symbol):
            starts = np.flatnonzero(np.append(True, cut[1:] != cut[:-1]))
            best = np.minimum.reduceat((rank << 32) | np.arange(len(rank)), starts)
            merge = (best >> 32) < NO_PIECE
            over = np.repeat(~merge, np.diff(np.append(starts, len(symbol))))
            if over.any():  # these agendas are empty
                done_symbols.append(symbol[over])
                done_cuts.append(cut[over])
            at = best[merge] & 0xFFFFFFFF
            symbol[at] = made[at]
            last[at] = last[at + 1]
            keep = ~over
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            symbol, cut, last, rank, made, at = symbol[keep], cut[keep], last[keep], rank[keep], made[keep], place[at]
            first = at[(at > 0) & (cut[at - 1] == cut[at])] - 1
            for i in (first, at[~last[at]]):
                rank[i], made[i] = self.rank(symbol[i], symbol[i + 1])
            rank[at[last[at]]] = NO_PIECE
        symbol, cut = np.concatenate(done_symbols), np.concatenate(done_cuts)
        order = np.argsort(cut, kind="stable")
        symbol, ends = symbol[order], np.cumsum(np.bincount(cut, minlength=len(cuts)))
        raw, strange = symbol.astype("<u4").tobytes(), {int(c) for c in np.unique(cut[order][symbol >= self.size])}
        out = [raw[4 * a : 4 * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        for c in strange:
            ids = [b for i in memoryview(out[c]).cast("I") for b in ([i] if i < self.size else [self.byte[x] for x in chr(i - self.size).encode()])]
            out[c] = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def encode_long(self, cut: str) -> bytes:
        """The ids of one cut of any length, by a heap."""
        score, symbols = self.score, list(cut)
        n = len(symbols)
        left, right, agenda = list(range(-1, n - 1)), [*range(1, n), -1], []
        for i in range(n - 1):
            piece = symbols[i] + symbols[i + 1]
            if piece in score:
                agenda.append((-score[piece], i, i + 1, piece))
        heapq.heapify(agenda)
        while agenda:
            _, i, j, piece = heapq.heappop(agenda)
            if not symbols[i] or right[i] != j or symbols[i] + symbols[j] != piece:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = piece, ""
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                if (new := piece + symbols[k]) in score:
                    heapq.heappush(agenda, (-score[new], i, k, new))
            if (h := left[i]) >= 0 and (new := symbols[h] + piece) in score:
                heapq.heappush(agenda, (-score[new], h, i, new))
        out: list[int] = []
        for s in symbols:
            if s:
                i = self.ids.get(s)
                out += [i] if i is not None else [self.byte[b] for b in s.encode()]
        return struct.pack(f"<{len(out)}I", *out)

    def split(self, text: str) -> list[str]:
        """The cuts of a text, each without its first mark."""
        words = text.split(" ")
        if MARK in text or "" in words:
            return [cut[1:] for cut in self.cuts.findall(MARK + text.replace(" ", MARK))] if text else []
        return words

    def learn(self, cuts: set[str]) -> None:
        """Encodes cuts that the memo lacks and checks all of them against the library."""
        if self.memo_chars > MEMO_CHARS:
            self.forget()
        new = [c for c in cuts if c not in self.memo]
        short = [c for c in new if len(c) < SHORT_CHARS]
        self.memo.update(zip(short, self.encode_short([MARK + c for c in short]) if short else [], strict=True))
        self.memo.update((c, self.encode_long(MARK + c)) for c in new if len(c) >= SHORT_CHARS)
        for cut, want in zip(new, self.library.encode([c.replace(MARK, " ") for c in new], num_threads=1), strict=True):
            if cut and self.memo[cut] != struct.pack(f"<{len(want)}I", *want):  # the library gives no ids for an empty text
                raise ValueError(f"agenda and library differ on a cut of {len(cut)} characters")
            self.memo_chars += len(cut)

    def forget(self) -> None:
        """Empties the memo. Workers outlive their tasks and keep the encoder, whose memo would stand beside all later stages."""
        self.memo, self.memo_chars = {}, 0
        pa.default_memory_pool().release_unused()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, begin and end ids included, as little-endian 32-bit integers."""
        split = [self.split(t) for t in texts]
        self.learn(set().union(*split))
        ids_of = self.memo.__getitem__
        return [b"".join([self.begin, *map(ids_of, cuts), self.end]) for cuts in split]


_loaded: dict[str, MergeVocabulary] = {}


def vocabulary(model_file: str) -> MergeVocabulary:
    """One encoder for each model and Python worker."""
    if model_file not in _loaded:
        _loaded[model_file] = MergeVocabulary(model_file)
    return _loaded[model_file]


def encode_texts(df: DataFrame, model_file: str, *, text_col: str = "text", ids_col: str | None = None) -> DataFrame:
    """df with n_tokens, ids_sha256, decoded_sha256 and, under ids_col if given, the ids themselves.

    decoded_sha256 is of the library's decode(ids). Raises where the agenda and the library differ.
    """
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if ids_col:
        added.append(T.StructField(ids_col, T.ArrayType(T.IntegerType())))
    kept = [f for f in df.schema.fields if f.name not in {a.name for a in added}]
    schema = T.StructType(kept + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model_file)
        lib = vocab.library
        try:
            for part in slices(batches, text_col, TEXT_BYTES):
                texts = [t or "" for t in part.column(text_col).to_pylist()]
                encoded = vocab.encode_all(texts)
                if encoded and lib.encode(texts[0], add_bos=True, add_eos=True) != list(memoryview(encoded[0]).cast("I")):
                    raise ValueError(f"agenda and library differ on a text of {len(texts[0])} characters")
                counts, digests, decoded, all_ids = [], [], [], []
                for raw in encoded:
                    ids = memoryview(raw).cast("I").tolist()
                    counts.append(len(ids))
                    digests.append(hashlib.sha256(raw).hexdigest())
                    decoded.append(hashlib.sha256(lib.decode(ids).encode()).hexdigest())
                    if ids_col:
                        all_ids.append(ids)
                columns = [part.column(f.name) for f in kept] + [pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
                if ids_col:
                    columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())
        finally:
            vocab.forget()

    return df.mapInArrow(run, schema)


def decode_ids(df: DataFrame, model_file: str, *, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """df with the text of each row's ids; a null list decodes to the empty text."""
    kept = [f for f in df.schema.fields if f.name != text_col]
    schema = T.StructType([*kept, T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = vocabulary(model_file).library
        for batch in batches:
            texts = [lib.decode(ids) if ids else "" for ids in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(texts, pa.string())], names=schema.fieldNames())

    return df.mapInArrow(run, schema)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text of documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_texts(docs, default_model()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
