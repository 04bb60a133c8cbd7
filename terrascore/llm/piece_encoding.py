"""Exact encoding and decoding for merge-type (BPE) SentencePiece models, by backtracking over longest matches.

The greedy merge order of the model is not replayed over a text. A text is walked from left to right: the longest
piece at the place (one pass of an Aho-Corasick automaton finds all) is tried, then its shorter prefixes; a piece is accepted when
re-merging it together with the piece before it gives back those two pieces, and a place from which every
continuation failed is marked in a bitfield and never tried again. A row of pieces in which each adjacent pair is
stable under merging is the one that merging the whole text would give, so the result is exact.

Texts: a null text is an empty text, with no ids. Characters without a piece become byte pieces. Repeated rows, null
ids, extra columns and very long texts need no special treatment; each text is encoded whole, and equal texts give equal
ids. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
#: Words kept per Python worker before the word table is emptied; bounds memory only.
WORD_TABLE = 500_000
#: A chunk that this is longer than is encoded without being kept.
KEPT_CHARS = 64
#: Spaces (as they are in the model's text) and what follows them up to the next spaces: no piece has a space after another character.
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+")

_MODELS: dict[str, PieceModel] = {}


class PieceModel:
    """Pieces, scores and byte pieces of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.special = {i for i in range(size) if model.is_control(i) or model.is_unknown(i)}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in self.byte_of and i not in self.special}
        self.rank = {p: model.get_score(i) for p, i in self.ids.items()}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece has a space after another character; texts can't be cut at spaces")
        self.known = {c for p in self.ids for c in p}
        stable = [p for p in self.ids if self._merge(p) == [p]]
        self.trie = ahocorasick.Automaton()
        for p in stable:
            self.trie.add_word(p, p)
        if stable:
            self.trie.make_automaton()
        known = set(stable)
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in known), None) for p in stable}
        self.parts = re.compile(f"[{re.escape(''.join(sorted(self.known)))}]+|.", re.S)
        self.lines_apart = "\n" not in self.known
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words = _Words(self)

    def _merge(self, text: str) -> list[str]:
        """The model's own merging of a short text: best score first, leftmost on ties."""
        out = list(text)
        while len(out) > 1:
            best, at = None, -1
            for i in range(len(out) - 1):
                score = self.rank.get(out[i] + out[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            out[at : at + 2] = [out[at] + out[at + 1]]
        return out

    def stable(self, left: str, right: str) -> bool:
        """Whether re-merging two adjacent pieces keeps them as they are."""
        if len(self.pairs) > 1_000_000:
            self.pairs.clear()
        found = self.pairs[left, right] = self._merge(left + right) == [left, right]
        return found

    def split(self, text: str) -> list[str]:
        """Pieces of a text whose characters all have pieces."""
        n, at = len(text), 0
        open_ = bytearray(b"\x01") * (n + 1)
        shorter, pairs, stable = self.shorter, self.pairs, self.stable
        longest: list[str] = [""] * n
        for end, p in self.trie.iter(text):  # ends come in order, so the longest piece of each place is the last one found
            longest[end + 1 - len(p)] = p
        out: list[str] = []
        last = piece = None
        while at < n:
            if piece is None:
                piece = longest[at]
            while piece:
                end = at + len(piece)
                if open_[end] and (last is None or pairs.get((last, piece)) or ((last, piece) not in pairs and stable(last, piece))):
                    out.append(piece)
                    at, last, piece = end, piece, None
                    break
                piece = shorter[piece]
            else:
                open_[at] = 0
                if not out:
                    raise ValueError("no encoding of " + text[:40])
                piece = out.pop()
                at -= len(piece)
                last = out[-1] if out else None
                piece = shorter[piece] or ""
        return out

    def encode_chunk(self, chunk: str) -> list[int]:
        ids = self.ids
        if self.known.issuperset(chunk):
            return [ids[p] for p in self.split(chunk)]
        out: list[int] = []
        for part in self.parts.findall(chunk):
            if part[0] in self.known:
                out += [ids[p] for p in self.split(part)]
            else:
                out += [self.bytes[b] for b in part.encode()]
        return out

    def decode_pieces(self, ids: list[int]) -> str:
        """Text of some ids: spaces for the space sign, runs of byte pieces as UTF-8; bytes that are no UTF-8 give U+FFFD each."""
        out: list[str] = []
        run = bytearray()
        for i in [*ids, None]:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()
            if i is not None and i not in self.special:
                out.append(self.pieces[i].replace(SPACE, " "))
        return "".join(out)

    def encode(self, text: str) -> list[int]:
        return [i for chunk in self.chunks(text) for i in self.encode_chunk(chunk)]

    def decode(self, ids: list[int]) -> str:
        """The decoded text; the space that encoding puts in front goes."""
        out = self.decode_pieces(ids)
        return out[1:] if out.startswith(" ") else out

    def chunks(self, text: str) -> list[str]:
        """The parts of a text that are encoded each by itself: at spaces, and at line ends if these have no piece."""
        if not text:
            return []
        text = text.replace(" ", SPACE)
        if not self.lines_apart:
            return re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", SPACE + text)
        if text[0] == SPACE or text[-1] == SPACE or SPACE * 2 in text or SPACE + "\n" in text:
            return _CHUNK.findall(SPACE + text)
        lines = text.replace(SPACE, " " + SPACE).split("\n")
        lines[0] = SPACE + lines[0]
        out: list[str] = []
        for line in lines:
            out += line.split(" ")
            out.append("\n")
        out.pop()
        return out

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the joined ids, decoded text) of a whole text."""
        if not text:
            return 0, hashlib.sha256(b"").hexdigest(), ""
        parts = [c for c in map(self.words.__getitem__, self.chunks(text)) if c]
        ids = ",".join(parts)
        decoded = "".join(map(self.words.decoded, parts))
        return ids.count(",") + 1, hashlib.sha256(ids.encode()).hexdigest(), decoded[1:] if decoded.startswith(" ") else decoded


class _Words(dict):
    """Chunk to its ids joined by commas, and those to the text they decode to. Emptied at WORD_TABLE chunks."""

    def __init__(self, owner: PieceModel):
        super().__init__()
        self.owner, self.texts = owner, {}

    def __missing__(self, chunk: str) -> str:
        ids = self.owner.encode_chunk(chunk) if chunk else []
        out = ",".join(map(str, ids))
        if len(chunk) <= KEPT_CHARS:
            if len(self) >= WORD_TABLE:
                self.clear()
                self.texts.clear()
            self[chunk] = out
        return out

    def decoded(self, joined: str) -> str:
        found = self.texts.get(joined)
        if found is None:
            found = self.owner.decode_pieces(list(map(int, joined.split(","))))
            if len(joined) <= 8 * KEPT_CHARS:
                self.texts[joined] = found
        return found


def _utf8(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(data):
            for k in (1, 2, 3, 4):
                try:
                    out.append(data[i : i + k].decode())
                    i += k
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


def model(path: str) -> PieceModel:
    """The model of a file, loaded once in each Python worker."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string), a row for each row. ``path`` names the model file, present on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            ids = [m.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([m.decode(i) for i in ids], pa.string())], ["id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"id {kind}, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256), a row for each row: encoding and decoding without keeping the ids. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            got = [m.digest(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string()), pa.array([hashlib.sha256(g[2].encode()).hexdigest() for g in got], pa.string())],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
