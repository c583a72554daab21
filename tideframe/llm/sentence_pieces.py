"""SentencePiece encoding and decoding with one forward pass over a trie of words, shared by common prefixes.

The distinct marked words of a slice are sorted, so a walk over them in order is a depth-first walk of their trie: what the
forward pass knows of a prefix stays on a stack and serves every word that begins with it.

The public model is of the merging kind. Its encoding of a prefix does not follow from sums of piece scores, so the pass keeps, per
prefix, the last piece of its encoding instead of the best sum: piece t may follow piece u exactly if merging u + t
gives u and t again, and one piece that ends at a position passes this test. The path found is the model's own encoding.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.llm.common import map_batches, once_per_worker, slices

MARK = "▁"
SLICE = 8_000_000
#: Words, and pairs of pieces, that a worker remembers in each of two generations.
REMEMBERED = 200_000


def default_model() -> str:
    from public_tokenizers import path

    return path("piece_bpe_32k.model")


def _fields(raw: bytes):
    """(number, value) of each field of a serialised message; nested messages are bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, raw[at : at + size]
        at += size


def model_kind(raw: bytes) -> str:
    """What kind of model a file holds, by the public message format: field 3 of the trainer's settings, which are field 2."""
    # The kinds of the format; a file that does not name one is of the first.
    kinds = {1: "unigram", 2: "bpe", 3: "word", 4: "char"}
    settings = b"".join(value for number, value in _fields(raw) if number == 2)
    return kinds.get(next((value for number, value in _fields(settings) if number == 3), 1), "unknown")


class PieceModel:
    """Pieces, scores and byte pieces of a model file, with the encoder's memory. Only merging models are encoded this way;
    a file of another kind is refused."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        with open(path, "rb") as file:
            kind = model_kind(file.read())
        if kind != "bpe":
            raise ValueError(f"{path} holds a {kind} model; this encoder follows merges")
        self.library = SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        pieces = [self.library.id_to_piece(i) for i in range(n)]
        special = [i for i in range(n) if self.library.is_byte(i) or self.library.is_control(i) or self.library.is_unknown(i)]
        self.ids = {p: i for i, p in enumerate(pieces) if i not in set(special)}
        self.score = {p: self.library.get_score(i) for p, i in self.ids.items()}
        self.byte_ids = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.raw = [b"" if self.library.is_control(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        for b, i in enumerate(self.byte_ids):
            self.raw[i] = bytes([b])
        self.raw[self.library.unk_id()] = " ⁇ ".encode()
        self.longest = max(map(len, self.ids))
        self.words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.runs: dict[int, tuple[int, ...]] = {}

    def merged(self, text: str) -> list[str]:
        """Merge the best-scored neighbours, the left ones of equals first, until no two join into a piece."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, u: str, t: str) -> bool:
        if len(self.pairs) > REMEMBERED:
            self.pairs.clear()
        known = self.pairs[u, t] = self.merged(u + t) == [u, t]
        return known

    def learn(self, words: list[str]) -> None:
        """Forward pass over the trie of sorted distinct ``words`` (each with its mark)."""
        ids, longest, follows, pairs = self.ids, self.longest, self.follows, self.pairs
        # last[i]: last piece of the encoding of the first i characters; None after a character that is no piece.
        last: list[str | None] = [None]
        before = ""
        for word in words:
            shared = 0
            top = min(len(before), len(word))
            while shared < top and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):
                found = None
                for start in range(i - 1, max(0, i - longest) - 1, -1):  # short pieces are the usual ones
                    piece = word[start:i]
                    if piece not in ids:
                        continue
                    u = last[start]
                    if u is None:
                        # Nothing joins across the start of a word or a character that is no piece.
                        if (start == 0 or word[start - 1] not in ids) and (len(piece) == 1 or self.merged(piece) == [piece]):
                            found = piece
                            break
                    else:
                        known = pairs.get((u, piece))
                        if follows(u, piece) if known is None else known:
                            found = piece
                            break
                last.append(found)
            before = word
            path: list[int] = []
            i = len(word)
            while i:
                piece = last[i]
                if piece is None:
                    path += [self.byte_ids[b] for b in reversed(word[i - 1].encode("utf-8", "surrogatepass"))]
                    i -= 1
                else:
                    path.append(ids[piece])
                    i -= len(piece)
            self.words[word] = tuple(reversed(path))

    def blanks(self, n: int) -> tuple[int, ...]:
        """Ids of ``n`` marks in a row; they join among themselves only after everything else."""
        if n not in self.runs:
            # The marks fill pieces from the left, the longest first.
            widest = max(k for k in range(1, self.longest + 1) if MARK * k in self.ids)
            full, rest = divmod(n, widest)
            self.runs[n] = (self.ids[MARK * widest],) * full + tuple(self.ids[p] for p in (self.merged(MARK * rest) if rest else ()))
        return self.runs[n]

    def encode(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for lo, hi in slices([len(t) for t in texts], SLICE):
            split = [(MARK + t.replace(" ", MARK)).split(MARK)[1:] if t else [] for t in texts[lo:hi]]
            if len(self.words) > REMEMBERED:
                self.words, self.older = {}, self.words
            wanted = set().union(*split)
            wanted.discard("")
            missing = {MARK + w for w in wanted}.difference(self.words)
            again = missing.intersection(self.older)
            self.words.update((w, self.older[w]) for w in again)
            self.learn(sorted(missing - again))
            known = {w: self.words[MARK + w] for w in wanted}
            for words in split:
                ids: list[int] = []
                held = 0
                for w in words:
                    if not w:
                        held += 1
                        continue
                    own = known[w]
                    if held:
                        # The last mark of a run belongs to the word, unless it stays alone there.
                        alone = own[0] == self.ids[MARK]
                        ids += self.blanks(held + alone)
                        own = own[1:] if alone else own
                        held = 0
                    ids += own
                if held:
                    ids += self.blanks(held)
                out.append(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def piece_model(path: str) -> PieceModel:
    return once_per_worker(f"pieces {path}", lambda: PieceModel(path))


def encode_pieces(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) of each whole text; null texts have null ids, empty ones none."""
    path = model or default_model()

    def run(c: dict[str, list]) -> dict:
        encoded = piece_model(path).encode([t or "" for t in c["text"]])
        return {"doc_id": c["doc_id"], "ids": [None if t is None else e for t, e in zip(c["text"], encoded)]}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """``doc_id`` and ``text`` from ids; null ids give a null text. Byte pieces that form no character become U+FFFD."""
    path = model or default_model()

    def run(c: dict[str, list]) -> dict:
        own = piece_model(path)
        return {"doc_id": c["doc_id"], "text": [None if x is None else own.decode(x) for x in c["ids"]]}

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Per row: ``doc_id, n_ids, ids_crc32`` (ids as little-endian 32-bit), ``decoded_crc32, same`` after decoding them again.

    A null text gives nulls; a text that holds the mark itself decodes to a blank there, as in the library. Rows are
    independent, so repeated rows and null ids are no special case, and an empty table gives no rows.
    """
    path = model or default_model()

    def run(c: dict[str, list]) -> dict:
        own = piece_model(path)
        out: dict[str, list] = {k: [] for k in ("n_ids", "ids_crc32", "decoded_crc32", "same")}
        texts = c["text"]
        for lo, hi in slices([len(t or "") for t in texts], SLICE):
            for text, ids in zip(texts[lo:hi], own.encode([t or "" for t in texts[lo:hi]])):
                back = own.decode(ids)
                row = (len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)), zlib.crc32(back.encode("utf-8", "surrogatepass")), back == text)
                for name, value in zip(out, row if text is not None else (None,) * 4):
                    out[name].append(value)
        return {"doc_id": c["doc_id"], **out}

    schema = "doc_id long, n_ids long, ids_crc32 long, decoded_crc32 long, same boolean"
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, schema)
