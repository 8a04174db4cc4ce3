"""Exact merge-type SentencePiece encoding by backtracking, and its decoding."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import releasing
from tidemark.llm.tokenizers_ import PIECES, vocabulary_path

SPACE = "▁"
#: Segments whose ids one worker remembers.
MEMO = 250_000
#: Pairs of neighbours whose fit it remembers.
PAIRS = 600_000


class PieceCodec:
    """Encodes and decodes like the library does for a model of merge type with byte fallback.

    Merging by score has one fixed point per string. It is found without a queue: the longest
    piece that starts at a position (from one Aho-Corasick pass) is tried first; it stands only if
    it and the piece before it come out of merging their joint string again, and if its end isn't a
    position known to fail (a bit field). Else the next shorter piece is tried, then the last piece
    is taken back. A text is first cut where no piece of the vocabulary crosses, so each part is
    encoded by itself and remembered.
    """

    def __init__(self, path: str) -> None:
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, trainer = model.normalizer_spec, model.trainer_spec
        if trainer.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or not trainer.byte_fallback:
            raise ValueError("only merge-type models with byte fallback that keep texts as they are")
        self.prefix = spec.add_dummy_prefix
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.bytes: list[bytes | None] = []
        self.byte_id = [0] * 256
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                value = int(p.piece[3:5], 16)
                self.byte_id[value] = i
                self.bytes.append(bytes([value]))
            elif p.type in (1, 4, 5):
                self.score[p.piece], self.id[p.piece] = p.score, i
                self.bytes.append(p.piece.replace(SPACE, " ").encode())
            else:
                self.bytes.append(None if p.type == 2 else b"")
        self.unk = next(i for i, p in enumerate(model.pieces) if p.type == 2)
        self.unk_surface = trainer.unk_surface.encode()
        self.is_byte = [p.type == 6 for p in model.pieces]
        self.names = [str(i) for i in range(len(model.pieces))]
        self.size = len(model.pieces)
        self.text = [p.piece for p in model.pieces]
        self.length = list(map(len, self.text))
        #: Number of the longest piece that is a proper prefix of a piece; -1 if there is none.
        self.shorter = [next((self.id[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.id), -1) for t in self.text]
        self.trie = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.trie.add_word(p, i)
        self.trie.make_automaton()
        inner = {c for p in self.score for c in p[1:]} | {p[0] for p in self.score if len(p) > 1}
        crossing = any(SPACE in p.lstrip(SPACE) for p in self.score)
        alone = "" if "\n" in inner else "\n"
        self.cut = re.compile((f"{alone}|" if alone else "") + (f".+" if crossing else f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+"), re.DOTALL)
        # Two generations: when the young one is full it becomes the old one.
        self.memo: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}
        self.known = frozenset(p for p in self.score if len(p) == 1)

    def merged(self, text: str) -> list[str]:
        """Merging by score, highest first and leftmost among equals: the definition itself."""
        parts: list[str | None] = list(text)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        queue = [(-self.score[p], i, p) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in self.score]
        heapify(queue)
        while queue:
            _, i, p = heappop(queue)
            j = after[i]
            if parts[i] is None or j >= len(parts) or parts[i] + parts[j] != p:
                continue
            parts[i], parts[j] = p, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(parts) and (q := parts[a] + parts[b]) in self.score:
                    heappush(queue, (-self.score[q], a, q))
        return [p for p in parts if p is not None]

    def _fits(self, last: int, own: int) -> bool:
        """Whether two neighbours come out of merging their joint string again."""
        a, b = self.text[last] if last >= 0 else "", self.text[own]
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        known = self.pairs[last * self.size + own] = self.merged(a + b) == ([a, b] if a else [b])
        return known

    def _known(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts in which each character is in the vocabulary, from one automaton pass."""
        joined = "\0".join(texts)  # no piece holds this mark, so no match crosses it
        longest = [-1] * (len(joined) + 2)
        length, shorter, n = self.length, self.shorter, self.size
        for end, i in self.trie.iter(joined):  # ends ascend, so the last for a start is the longest
            longest[end + 1 - length[i]] = i
        failed = bytearray(len(joined) + 2)
        pairs, out, begin = self.pairs, [], 0
        for text in texts:
            ids: list[int] = []
            last, at, own = -1, begin, longest[begin]
            begin += len(text) + 1
            while own >= 0:
                while True:
                    if not failed[at + length[own]]:
                        fits = pairs.get(last * n + own)
                        if fits is None:
                            fits = self._fits(last, own)
                        if fits:
                            ids.append(own)
                            at += length[own]
                            last, own = own, longest[at]
                            break
                    own = shorter[own]
                    if own < 0:
                        failed[at] = 1
                        own = ids.pop()
                        at -= length[own]
                        last = ids[-1] if ids else -1
                        break
            out.append(ids)
        return out

    def _segments(self, parts: list[str]) -> Iterator[tuple[str, tuple[int, ...]]]:
        """Each part with its ids; characters outside the vocabulary become their bytes."""
        plain = []
        for part in parts:
            if part.startswith(SPACE * 2) or not self.known.issuperset(part):
                yield part, self._mixed(part)
            else:
                plain.append(part)
        for part, pieces in zip(plain, self._known(plain), strict=True):
            yield part, tuple(pieces)

    def _mixed(self, text: str) -> tuple[int, ...]:
        ids: list[int] = []
        begin = 0
        for i in range(len(text) + 1):
            if i == len(text) or text[i] not in self.known:
                if begin < i:
                    own = text[begin:i]
                    # Runs of one repeated mark hold pieces of equal score, where order alone decides.
                    ids += map(self.id.__getitem__, self.merged(own)) if own.startswith(SPACE * 2) else self._known([own])[0]
                if i < len(text):
                    ids += [self.byte_id[b] for b in text[i].encode("utf-8", "surrogatepass")]
                begin = i + 1
        return tuple(ids)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        text = text.replace(" ", SPACE)
        if self.prefix:
            text = SPACE + text
        parts = self.cut.findall(text)
        memo, old = self.memo, self.old
        if len(memo) >= MEMO:
            self.old = old = memo
            self.memo = memo = {}
        found = list(map(memo.get, parts))
        if None in found:
            fresh = []
            for p in {p for p, ids in zip(parts, found, strict=True) if ids is None}:
                if (ids := old.get(p)) is None:
                    fresh.append(p)
                else:
                    memo[p] = ids
            long = {}
            for p, ids in self._segments(fresh):
                (memo if len(p) <= 64 else long)[p] = ids
            found = [memo.get(p) or long[p] if ids is None else ids for p, ids in zip(parts, found, strict=True)]
        return list(chain.from_iterable(found))

    def forget(self) -> None:
        """Drop what was remembered of texts; a worker outlives its task."""
        self.memo, self.old, self.pairs = {}, {}, {}

    def decode(self, ids: list[int]) -> str:
        """Text of the ids: control pieces are empty, broken byte runs become U+FFFD, the prefix goes."""
        own = self.bytes
        if self.unk in ids:
            raw = b"".join(self.unk_surface if i == self.unk else own[i] for i in ids)
        else:
            raw = b"".join(map(own.__getitem__, ids))
        if self.prefix and ids and raw[:1] == b" " and not self.is_byte[ids[0]]:
            raw = raw[1:]
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return _replaced(raw)


def _replaced(raw: bytes) -> str:
    """Each byte that starts no whole character becomes one U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode("utf-8"))
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def map_texts(docs: DataFrame, row, columns: list[tuple[str, pa.DataType, str]], path: str) -> DataFrame:
    """doc_id and what ``row(codec, text)`` gives for each whole text, as named columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            step = 256
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                rows = [row(own, t) for t in part.column(1).to_pylist()]
                data = [pa.array([r[i] for r in rows], kind) for i, (_, kind, _) in enumerate(columns)]
                yield pa.RecordBatch.from_arrays([part.column(0), *data], ["doc_id", *(c for c, _, _ in columns)])
        own.forget()

    schema = "doc_id long, " + ", ".join(f"{name} {sql}" for name, _, sql in columns)
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(releasing(run), schema)


def encode_documents(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """``doc_id, ids, decoded`` of every whole text, without begin or end ids.

    A null or empty text has no ids and decodes to the empty string. Rows are independent:
    repeated rows and doc_ids give repeated results, an empty table an empty one, and columns other
    than doc_id and text are ignored.
    """

    def row(own: PieceCodec, text: str | None) -> tuple:
        ids = own.encode(text)
        return ids, own.decode(ids)

    return map_texts(docs, row, [("ids", pa.list_(pa.int32()), "array<int>"), ("decoded", pa.string(), "string")], vocabulary_path(PIECES, folder))


def digest_documents(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Counts and digests of the ids and of the text that they decode to."""
    from hashlib import sha256

    def row(own: PieceCodec, text: str | None) -> tuple:
        ids = own.encode(text)
        joined = ",".join(map(own.names.__getitem__, ids))
        return len(ids), sha256(joined.encode()).hexdigest(), sha256(own.decode(ids).encode("utf-8", "surrogatepass")).hexdigest()

    kinds = [("n_tokens", pa.int64(), "long"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")]
    return map_texts(docs, row, kinds, vocabulary_path(PIECES, folder))
