"""Exact token ids by the public libraries, with a bounded cache of word encodings.

For vocabularies whose pre-tokenizer never lets a token span white space, a text's ids are its words' ids in turn, so
each distinct piece is encoded by the library once and looked up from then on. Any other vocabulary, and any text with
special strings or rare white space, goes to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

#: The pre-tokenizer pattern of vocabularies that drop white space; fixed value of the vocabulary file's format.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters and numbers among the characters for which all libraries agree on class, case and composition.
LETTER, NUMBER = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
#: The same split for texts of only those characters.
PLAIN_SPLIT = re.compile(rf"[{LETTER}]+|'(?:s|t|re|ve|m|ll|d)|[{NUMBER}]|[^\s{LETTER}{NUMBER}]+")
#: A text with any other character goes to the library whole.
ODD = re.compile("[^\x00-\x1b\x20-\x84\x86-\x9f\xa1-\u024f\u2010-\u2027\u2030-\u205e\u20ac]")


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    ``entries`` bounds the cache; a full one is emptied, which costs time and never changes ids.
    """

    def __init__(self, path: str, entries: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.path, self.entries = path, entries
        if path.endswith(".model"):
            import sentencepiece

            self.model, self.tok, self.by_word = sentencepiece.SentencePieceProcessor(model_file=path), None, False
            return
        from tokenizers import Tokenizer, pre_tokenizers

        self.model, self.tok = None, Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [x.get("pattern", {}).get("Regex") for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.suffix = spec["model"].get("end_of_word_suffix")
        self.by_word = bool(steps) and steps[0] == WORD_PATTERN and kinds == ["NFC", "Replace", "Lowercase"] and self.suffix == "</w>"
        self.special = [x["content"] for x in spec["added_tokens"]]
        alphabet = sorted(pre_tokenizers.ByteLevel.alphabet())
        own = [b for b in range(256) if chr(b) in alphabet]
        rest = [b for b in range(256) if b not in own]
        self.byte_chars = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.pieces = Pieces(self.tok, self.byte_chars)
        self.mixed: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        """Ids of one text straight from the library."""
        if self.model is not None:
            ids = self.model.encode(text, num_threads=1)
        else:
            ids = self.tok.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def _looked_up(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a slab: ids of its distinct words end to end, their lengths, each word's number, words before each text."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(self.pieces) + len(self.mixed) > self.entries:
            self.pieces.clear()
            self.mixed.clear()
        rare = {k for k, t in enumerate(texts) if ODD.search(t) or any(s in t for s in self.special)}
        split = pc.ascii_split_whitespace(pa.array(["" if k in rare else t.lower() for k, t in enumerate(texts)], pa.large_string()))
        coded = split.values.dictionary_encode()
        get, mixed = self.pieces.__getitem__, self.mixed
        known = []
        for word in coded.dictionary.to_numpy(zero_copy_only=False).tolist():
            if word.isalpha():
                known.append(get(word))
            elif word in mixed:
                known.append(mixed[word])
            else:
                known.append(mixed.setdefault(word, b"".join(map(get, PLAIN_SPLIT.findall(word)))))
        numbers, before = coded.indices.to_numpy(zero_copy_only=False), np.asarray(split.offsets).astype(np.int64)
        if rare:
            extra, numbers = self._with_whole(texts, sorted(rare), known, numbers, before)
            before = before + extra
        return np.frombuffer(b"".join(known), "<u4"), np.fromiter(map(len, known), np.int64, len(known)) // 4, numbers, before

    def _with_whole(self, texts, rare, known, numbers, before):
        """Insert for each rare text one word that stands for all its ids."""
        own = np.arange(len(known), len(known) + len(rare))
        known.extend(self.whole(texts[k]) for k in rare)
        extra = np.zeros(len(before), np.int64)
        extra[np.array(rare) + 1] = 1
        return np.cumsum(extra), np.insert(numbers, before[rare], own)

    def counts(self, texts: list[str]) -> np.ndarray:
        """Number of ids of each text of a slab."""
        if not self.by_word:
            return np.array([len(self.whole(t)) // 4 for t in texts], np.int64)
        _, lengths, numbers, before = self._looked_up(texts)
        return np.diff(np.concatenate(([0], np.cumsum(lengths[numbers])))[before])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text of a slab."""
        if not self.by_word:
            return [np.frombuffer(self.whole(t), "<u4") for t in texts]
        ids, lengths, numbers, before = self._looked_up(texts)
        take = lengths[numbers]
        until = np.concatenate(([0], np.cumsum(take)))
        starts = (np.cumsum(lengths) - lengths)[numbers]
        out = ids[np.repeat(starts - until[:-1], take) + np.arange(until[-1])]
        ends = until[before]
        return [out[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


class Pieces(dict):
    """Ids of single pieces; a missing one is merged by the library's own model."""

    def __init__(self, tok, byte_chars: dict[int, str]):
        super().__init__()
        self.tokenize, self.byte_chars = tok.model.tokenize, byte_chars

    def __missing__(self, piece: str) -> bytes:
        raw = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.byte_chars)
        ids = self[piece] = array("I", [t.id for t in self.tokenize(raw)]).tobytes()
        return ids


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per vocabulary and Python worker; its cache lives as long as the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def file_version(path: str) -> str:
    """Digest of a vocabulary file, so that stored counts of another vocabulary are never used."""
    import hashlib

    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()
