"""The public tokenizer libraries behind the word table, one encoder for each Python worker."""

from __future__ import annotations

import functools
import json
from array import array

import numpy as np

from .bpe import BYTE_CHAR
from .wordtable import TextCodec


class LibraryEncoder:
    """Ids as the tokenizers library gives them with add_special_tokens=False, truncation and padding off.

    New words go to the library's merge model one by one; texts whose words the byte classes don't decide, and files with
    another normaliser or word pattern than the two known here, go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        cut = self._cut(path)
        self.codec = TextCodec(cut, self._new, self._whole) if cut else None

    @staticmethod
    def _cut(path: str) -> str | None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, norm = spec["pre_tokenizer"], spec["normalizer"]
        if norm is None and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
            return "spaced"
        if norm and [x["type"] for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            parts = pre.get("pretokenizers", [])
            if [x["type"] for x in parts] == ["Split", "ByteLevel"] and parts[0]["invert"] and r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" in parts[0]["pattern"]["Regex"]:
                return "unspaced"
        return None

    def _new(self, words: list[bytes]) -> list[bytes]:
        shown, tokenize = BYTE_CHAR.__getitem__, self.tokenizer.model.tokenize
        return [array("I", [t.id for t in tokenize("".join(map(shown, w)))]).tobytes() for w in words]

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.codec.encode(texts) if self.codec else [self._whole(t) if t else np.empty(0, np.uint32) for t in texts]


@functools.lru_cache(maxsize=4)
def tokenizer(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


class PieceCounter:
    """Token counts as sentencepiece gives them.

    Where the model changes no character, marks words by a leading space sign and has no piece with that sign further
    in, no merge crosses a space, and a text's count is the sum of its words' counts.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.codec = TextCodec("blanks", self._new, self._whole, self._plain) if self._by_word(path) else None

    def _by_word(self, path: str) -> bool:
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("\u2581" in p[1:] and p.strip("\u2581") for p in pieces):
            return False
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm = spec.normalizer_spec
        return norm.name == "identity" and not norm.precompiled_charsmap and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not spec.trainer_spec.treat_whitespace_as_suffix and not any(p.type == 4 for p in spec.pieces)

    @staticmethod
    def _plain(text: str) -> bool:
        return not ("  " in text or text[0] == " " or text[-1] == " " or "\u2581" in text or "\0" in text)

    def _new(self, words: list[bytes]) -> list[bytes]:
        return [len(x).to_bytes(4, "little") for x in self.model.encode([w.decode() for w in words], num_threads=1)]

    def _whole(self, text: str) -> np.ndarray:
        return np.array([len(self.model.encode(text))], dtype=np.uint32)

    def counts(self, texts: list[str]) -> list[int]:
        if self.codec:
            return [int(x.sum()) for x in self.codec.encode(texts)]
        return [len(x) for x in self.model.encode(texts, num_threads=1)]


@functools.lru_cache(maxsize=2)
def counter(path: str):
    return PieceCounter(path) if path.endswith(".model") else LibraryEncoder(path)
