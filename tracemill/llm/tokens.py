"""Token ids of whole texts with a given tokenizer file.

The word tokenizer cuts a text into words, numbers and signs and never joins ids across them, so each distinct part is
encoded once and remembered. The memory is bounded: when the newer half is full the older half is forgotten.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import regex

from tracemill.llm import memory

BLOCK_CHARS = 1 << 20
KEEP = 150_000
#: The split pattern and the word end of the tokenizers for which remembered parts are valid.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
#: Below this character composition and lower case act on single characters, by rules that no Unicode version changes.
PLAIN_BELOW = "İ"
#: Words in one call of the library.
AT_ONCE = 500


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def plain_pattern() -> re.Pattern:
    """``WORD_PATTERN`` for lower-case texts of characters below ``PLAIN_BELOW``, for the faster standard module."""
    letters, numbers, spaces = (
        re.escape("".join(c for c in map(chr, range(ord(PLAIN_BELOW))) if regex.match(kind, c))) for kind in (r"\p{L}", r"\p{N}", r"\s")
    )
    return re.compile(f"[{letters}]+|'(?:s|t|re|ve|m|ll|d)|[{numbers}]|[^{spaces}{letters}{numbers}]+")


def is_plain(text: str) -> bool:
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return max(text) < PLAIN_BELOW


class Remembered(dict):
    """A dict of two halves."""

    def __init__(self, keep: int):
        super().__init__()
        self.keep, self.older = keep, {}

    def lookup(self, keys: set) -> dict:
        """The value of each key, None if it is in neither half; those of the older half move to the newer."""
        get, found = self.get, {}
        for key in keys:
            value = get(key)
            if value is None and self.older and (value := self.older.get(key)) is not None:
                self[key] = value
            found[key] = value
        return found

    def shrink(self) -> None:
        if len(self) > self.keep:
            self.older = dict(self)
            self.clear()


class TextTokenizer:
    """Ids without special tokens; equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str, keep: int = KEEP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        norms = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.by_word = (
            steps[0].get("pattern", {}).get("Regex") == WORD_PATTERN and norms == ["NFC", "Replace", "Lowercase"]
            and spec["model"].get("end_of_word_suffix") == WORD_END
        )
        self.specials = tuple(t["content"] for t in spec.get("added_tokens", []))
        self.part = Tokenizer(self.whole.model)
        self.part.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.whole.get_vocab_size(), bool)
        for token, number in self.whole.get_vocab().items():
            self.ends[number] = token.endswith(WORD_END)
        self.pattern = plain_pattern()
        self.known = Remembered(keep)

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.whole.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(x.ids, self.dtype).tobytes() for x in found]

    def _parts(self, text: str) -> list:
        """Parts as lower-case strings; runs between white space that are not plain as they are, as bytes."""
        if is_plain(text) and not any(s in text for s in self.specials):
            return self.pattern.findall(text.lower())
        parts = []
        for run in text.encode().split():
            word = run.decode()
            if is_plain(word) and not any(s in word for s in self.specials):
                parts += self.pattern.findall(word.lower())
            else:
                parts.append(run)
        return parts

    def _learn(self, parts: list) -> dict:
        """Ids of new parts. Many plain ones go to the library in one text; their ends are seen in the ids."""
        odd = [p for p in parts if isinstance(p, bytes)]
        plain = [p for p in parts if isinstance(p, str)]
        new = dict(zip(odd, self._ids([p.decode() for p in odd]), strict=True))
        if plain:
            found = self.part.encode_batch_fast([" ".join(plain[i:i + AT_ONCE]) for i in range(0, len(plain), AT_ONCE)], add_special_tokens=False)
            ids = np.concatenate([np.asarray(x.ids, self.dtype) for x in found])
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * self.dtype.itemsize).tolist()
            data = ids.tobytes()
            new.update(zip(plain, [data[a:b] for a, b in zip([0, *cuts], cuts, strict=False)], strict=True))
        return new

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian ids of each text, ``dtype`` wide."""
        if not self.by_word:
            return self._ids([t or "" for t in texts])
        split = [self._parts(t) if t else [] for t in texts]
        local = self.known.lookup(set(chain.from_iterable(split)))
        new = self._learn([p for p, ids in local.items() if ids is None])
        local.update(new)
        self.known.update(new)
        self.known.shrink()
        get = local.__getitem__
        return [b"".join(map(get, parts)) for parts in split]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> TextTokenizer:
    """One per worker process, kept between tasks."""
    return TextTokenizer(path)


memory.remembered(tokenizer.cache_clear)


def blocks(texts: list[str | None], limit: int = BLOCK_CHARS):
    """Ranges of texts with about ``limit`` characters together, at least one text each."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text or "") > limit:
            yield begin, i
            begin, size = i, 0
        size += len(text or "") + 1
    if begin < len(texts):
        yield begin, len(texts)
