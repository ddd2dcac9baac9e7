"""Token ids of whole texts by the tokenizers library, memoised by space-led piece."""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import kept

GROUP = 4_000_000  # characters that are encoded together
UNSAFE = re.compile(r" (?=\s)")
BREAKS = re.compile(r" (?=\S)")
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write each byte: printable ones as themselves, the others from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class PieceEncoder(dict):
    """Encodes texts to little-endian unsigned 32-bit ids; itself the memory of ids by piece.

    A byte-level tokenizer cuts before every space that a non-space follows, whatever stands around it, so a
    text's ids are those of its space-led pieces put together. A piece of letters and closing marks is one or two of
    the tokenizer's own cuts, and goes straight to the library's model; any other piece goes through the whole
    library. Ids of up to `most` pieces are kept; then the memory is emptied and fills again. Tokenizers of other
    kinds encode every text whole. Strings of special tokens are ordinary text. A null text has no ids.
    """

    def __init__(self, path: str, most: int = 700_000):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.tok.no_padding()
        self.tok.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, post = (spec.get(k) or {} for k in ("pre_tokenizer", "post_processor"))
        self.by_piece = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and spec["model"]["type"] == "BPE" and not post
        self.bpe = self.tok.model.tokenize
        self.letters = {b: c for b, c in byte_letters().items() if chr(b) != c}
        self.space = byte_letters()[32]
        self.line = self._whole("\n")
        self.most = most
        self.size = max(self.tok.get_vocab().values()) + 1

    def _whole(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _bpe(self, letters: str, led: bool) -> bytes:
        """Ids of what the tokenizer doesn't cut."""
        if not letters.isascii():
            letters = letters.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.bpe(self.space + letters if led else letters)]).tobytes()

    def _piece(self, piece: str, led: bool) -> bytes:
        stem = piece.rstrip(MARKS)
        if stem.isalpha():
            if len(stem) == len(piece):
                return self._bpe(stem, led)
            return self[stem if led else "\n" + stem] + self["\n" + piece[len(stem) :]]
        first, line, rest = piece.partition("\n")
        if first and rest and not first[-1].isspace() and not rest[0].isspace():
            return self[first if led else "\n" + first] + self.line + self["\n" + rest]
        return self._whole(" " * led + piece)

    def __missing__(self, piece: str) -> bytes:
        """A piece with a space before it, or after a line end one without."""
        stem = piece.rstrip(MARKS)
        if stem.isalpha():  # what _piece() would do, without calls, as it is the usual case
            if len(stem) < len(piece):
                out = self[stem] + self["\n" + piece[len(stem) :]]
            else:
                key = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
                out = array("I", [t.id for t in self.bpe(self.space + key)]).tobytes()
        elif piece[:1] != "\n":
            out = self._piece(piece, True)
        elif not piece[1:].strip(MARKS):
            out = self._bpe(piece[1:], False)
        else:
            out = self._piece(piece[1:], False)
        if len(self) >= self.most:
            self.clear()
        self[piece] = out
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; of many texts each distinct piece is looked up once."""
        out: list[bytes] = []
        group: list[str] = []
        size = 0
        for t in texts:
            group.append(t or "")
            size += len(group[-1])
            if size >= GROUP:
                out += self._group(group)
                group, size = [], 0
        return out + self._group(group) if group else out

    def _group(self, texts: list[str]) -> list[bytes]:
        if not self.by_piece:
            return [self._whole(t) if t else b"" for t in texts]
        loose = [i for i, t in enumerate(texts) if UNSAFE.search(t)]
        if loose:
            texts = list(texts)
            kept = {}
            for i in loose:
                head, *rest = BREAKS.split(texts[i])
                kept[i] = (self._piece(head, False) if head else b"") + b"".join([self[w] for w in rest])
                texts[i] = ""
        lists = pc.split_pattern(pa.array(texts, pa.string()), " ")
        coded = lists.flatten().dictionary_encode()
        codes, first = coded.indices.to_numpy().copy(), lists.offsets.to_numpy()
        heads = coded.dictionary.take(coded.indices.take(lists.offsets[:-1])).to_pylist()
        ids = list(map(self.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False).tolist()))  # quicker than to_pylist()
        codes[first[:-1]] = np.arange(len(ids), len(ids) + len(texts))
        ids += [self._piece(h, False) if h else b"" for h in heads]
        at, first = ids.__getitem__, first.tolist()
        out = [b"".join(map(at, codes[a:b].tolist())) for a, b in zip(first, first[1:])]
        for i in loose:
            out[i] = kept[i]
        return out


def encoder_of(path: str) -> PieceEncoder:
    """One encoder for each Python worker: what a task has learned serves the next."""
    return kept(("encoder", path), lambda: PieceEncoder(path))
