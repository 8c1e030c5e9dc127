"""SentencePiece encoding and decoding by a shared-prefix forward pass.

A text is marked as the library does (blanks become U+2581, one more is put in front) and cut into
marked words: a run of marks and what follows up to the next one. No piece of the vocabulary holds
a mark after another character (checked at load), so the encoding of the text is that of its words.
The distinct words of a batch are sorted, which lays them out as a trie in depth-first order: the
forward states of a prefix shared with the word before stay on the stack, and only the rest of the
word is worked out. Characters without a piece fall back to byte pieces.

A state is what is known of the best encoding of a prefix: its last piece, the ids of that piece and
where it starts; the ids of a word are written by walking back over these starts once. Under the
rule of a BPE file, a path is the library's own result exactly when no two neighbouring pieces
would have been merged across their border before each was complete; so, of the pieces that end at
a position, the one that fits the last piece of the prefix before it goes on, and there is one.
(Summed scores, as for a unigram file, would give other pieces than the library here: the scores of
a BPE file are merge ranks.) The results equal the library's on every text.

Defined results: a null text gives null ids, an empty one none; a literal U+2581 decodes to a
blank (the library's own loss); repeated rows repeat; other columns are ignored; long texts are
handled whole, word by word.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

MARK = "▁"
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Words kept with their ids in each worker; when full, it starts anew.
MEMO = 500_000
NONE = (None, None, None)


class Model:
    """The vocabulary of a SentencePiece BPE file: pieces, merge ranks, byte pieces."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.ranks: dict[str, float] = {}
        self.spines: dict[tuple[str, bool], list[tuple[str, float]]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.bytes: dict[int, int] = {}
        self.texts: list[bytes] = []
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:-1], 16)] = i
                self.texts.append(bytes([int(piece[3:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.texts.append(b"")
            else:
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"piece {i} holds a mark after another character")
                self.ids[piece] = i
                self.ranks[piece] = -sp.get_score(i)
                self.texts.append(piece.replace(MARK, " ").encode())
        if len(self.bytes) != 256:
            raise ValueError("a vocabulary with all byte pieces is needed")
        #: the pieces read backwards, as a trie: char -> (id bytes and piece if one ends here, further chars)
        self.root: dict[str, tuple] = {}
        for piece in sorted(self.ids, key=len):
            level = self.root
            for char in reversed(piece[1:]):
                if char not in level or level[char][2] is None:
                    level[char] = (*level.get(char, NONE)[:2], {})
                level = level[char][2]
            level[piece[0]] = (array("i", [self.ids[piece]]).tobytes(), piece, level.get(piece[0], NONE)[2])
        self.memo: dict[str, bytes] = {}

    def spine(self, piece: str, right: bool) -> list[tuple[str, float]]:
        """The symbols at one end of a piece while it is merged together, and the rank of the merge that ends each."""
        key = (piece, right)
        if key not in self.spines:
            parts = list(piece)
            out = [(parts[-1 if right else 0], math.inf)]
            while len(parts) > 1:
                rank, at = min((self.ranks.get(x + y, math.inf), i) for i, (x, y) in enumerate(zip(parts, parts[1:])))
                if rank == math.inf:
                    return self.spines.setdefault(key, [])  # merges never give this piece
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
                edge = parts[-1 if right else 0]
                if edge != out[-1][0]:
                    out[-1] = (out[-1][0], rank)
                    out.append((edge, math.inf))
            self.spines[key] = out
        return self.spines[key]

    def fits(self, left: str, right: str) -> bool:
        """Whether the merges leave these neighbours apart: at equal ranks the merge further left comes first."""
        a, b = self.spine(left, True), self.spine(right, False)
        i = j = 0
        while True:
            (x, x_end), (y, y_end) = a[i], b[j]
            rank = self.ranks.get(x + y, math.inf)
            if rank < x_end and rank <= y_end and rank < math.inf:
                return False
            if x_end == y_end == math.inf:
                return True
            if x_end <= y_end:
                i += 1
            if y_end <= x_end:
                j += 1

    def segment(self, words: list[str]) -> list[bytes]:
        """Ids (as little-endian 32-bit integers) of distinct words, given in sorted order."""
        root, pairs = self.root, self.pairs
        last, own, back = [""], [b""], [0]  # the stack: last piece, its ids and its start, per prefix length
        before, out = "", []
        for word in words:
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            del last[shared + 1:], own[shared + 1:], back[shared + 1:]
            end = shared
            for char in word[shared:]:
                ids, piece, longer = root.get(char, NONE)
                ends = [] if ids is None else [(end, ids, piece)]
                start = end
                while longer and start:  # longer pieces, as long as one ends like this
                    start -= 1
                    found = longer.get(word[start])
                    if found is None:
                        break
                    ids, piece, longer = found
                    if ids is not None:
                        ends.append((start, ids, piece))
                end += 1
                for start, ids, piece in reversed(ends):
                    key = (last[start], piece)
                    good = pairs.get(key)
                    if good is None:
                        good = bool(self.spine(piece, True)) and (not key[0] or self.fits(*key))
                        if len(pairs) < MEMO:
                            pairs[key] = good
                    if good:
                        last.append(piece)
                        own.append(ids)
                        back.append(start)
                        break
                else:
                    last.append("")  # bytes never merge with anything
                    own.append(self.fallback(char))
                    back.append(end - 1)
            path = []
            while end:
                path.append(own[end])
                end = back[end]
            out.append(b"".join(reversed(path)))
            before = word
        return out

    def fallback(self, char: str) -> bytes:
        return array("i", [self.bytes[b] for b in char.encode("utf-8", "surrogatepass")]).tobytes()

    def words(self, text: str) -> list[str]:
        """The marked words of a text, each without its first mark."""
        if MARK not in text and "  " not in text and text[:1] != " " and text[-1:] != " ":
            return text.split(" ")  # single blanks only: one mark in front of each word
        return [w[1:] for w in _WORD.findall(MARK + text.replace(" ", MARK))]

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        split = [None if t is None else self.words(t) if t else [] for t in texts]
        distinct = set().union(*(words for words in split if words))
        known = self.memo
        new = sorted(distinct - known.keys())
        fresh = dict(zip(new, self.segment([MARK + w for w in new])))
        if len(known) + len(fresh) > MEMO:
            self.memo = known = {w: known[w] for w in distinct if w in known}
        known.update(fresh)
        out = [None if words is None else b"".join(map(known.__getitem__, words)) for words in split]
        for w in [w for w in new if len(w) > 64]:  # not worth keeping
            del known[w]
        if len(known) > MEMO:
            known.clear()
        return out

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.texts.__getitem__, array("i", ids))).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def encode(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, n_ids, ids_crc32 (of the little-endian 32-bit ids), round_trip (they decode to the text)."""
    schema = "doc_id long, ids array<int>, n_ids long, ids_crc32 long, round_trip boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(model_path)
        for b in slices(batches, "text"):
            texts = b.column("text").to_pylist()
            ids = model.encode(texts)
            same = [None if t is None else model.decode(x) == t.replace(MARK, " ") for t, x in zip(texts, ids)]
            offsets = [0]
            for x in ids:
                offsets.append(offsets[-1] + len(x or b"") // 4)
            values = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(x or b"" for x in ids))])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=pa.array([x is None for x in ids]))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), lists, pa.array([None if x is None else len(x) // 4 for x in ids], pa.int64()),
                 pa.array([None if x is None else zlib.crc32(x) for x in ids], pa.int64()), pa.array(same, pa.bool_())],
                ["doc_id", "ids", "n_ids", "ids_crc32", "round_trip"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, model_path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of arrays of ids; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(model_path)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                texts = [None if x is None else model.decode(array("i", x).tobytes()) for x in b.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def public_pieces() -> str:
    import public_tokenizers as P

    return P.path("piece_bpe_32k.model")


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), public_pieces())
