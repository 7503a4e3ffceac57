"""Exact word splitting for the tokenizer kind of word_bpe_49k.json, and ids of single words.

The kind: special strings are cut out first; the rest is normalised (NFC, white space, lower case),
split into words by a pattern, and each word is encoded by itself. So a word's ids are the same
wherever it stands.
"""

from __future__ import annotations

import json

import regex
from tokenizers import Tokenizer

#: The pattern of the tokenizer's file.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Texts of these characters alone are in NFC, and every Unicode version agrees on their classes and lower case.
PLAIN = regex.compile(r"[\t-\r -~\xa0-įı-ɏ]*+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 as itself, the others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordBpe:
    def __init__(self, path: str):
        self.tok = Tokenizer.from_file(path)
        self.model, self.norm, self.pre = self.tok.model, self.tok.normalizer, self.tok.pre_tokenizer
        with open(path, encoding="utf-8") as f:
            self.special = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.letters = _byte_letters()
        self.bytes = {c: b for b, c in self.letters.items()}

    def tokens(self, text: str) -> list[str]:
        """What white space separates, in order, for words_of(); no word crosses white space, so a token has the same words wherever it stands.

        A special string is a token with a space before it, and a word that the library has cut one with a tab before it.
        """
        if "<|" in text and self.cut.search(text):
            out: list[str] = []
            for i, part in enumerate(self.cut.split(text)):
                out += [" " + part] if i % 2 else self._tokens(part)
            return out
        return self._tokens(text)

    def _tokens(self, text: str) -> list[str]:
        if PLAIN.fullmatch(text):
            return text.lower().split()
        pieces = self.pre.pre_tokenize_str(self.norm.normalize_str(text)) if text else []
        return ["\t" + bytes(map(self.bytes.__getitem__, p)).decode() for p, _ in pieces]

    def words_of(self, token: str) -> list[str]:
        if token[0] == "\t":
            return [token[1:]]
        return [token] if token[0] == " " else SPLIT.findall(token)

    def words(self, text: str) -> list[str]:
        """The words of a text in order; a special string is one word with a space before it."""
        return [w for t in self.tokens(text) for w in self.words_of(t)]

    def ids(self, word: str) -> list[int]:
        if word[0] == " ":
            return [self.special[word[1:]]]
        return [t.id for t in self.model.tokenize("".join(map(self.letters.__getitem__, word.encode())))]

    def pieces(self) -> list[str]:
        """The string of each id."""
        vocab = self.tok.get_vocab(with_added_tokens=True)
        out = [""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            out[i] = piece
        return out
