"""Splitting texts where no token can cross, and encoding each distinct piece once."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable

import numpy as np

#: Letters that stay one letter in lower case, so without U+0130, which becomes a letter and a mark.
_LATIN = "A-Za-zÀ-ÖØ-öø-\u012f\u0131-ɏ"
#: ASCII symbols but for the apostrophe (contractions) and the less-than sign (special strings begin with it).
_SYMBOLS = r"!-&(-/:;=-@\[-`{-~"
_RUN = rf"[{_LATIN}]++(?=[\x00-\x7f]|\Z)| ?[{_SYMBOLS}]++(?=[\sA-Za-z0-9]|\Z)| ?\S+"
#: Runs of Latin letters, runs of symbols and what else stands between white space; byte-level encoders also
#: see white space: one blank goes with what follows it, the last of a run alone, the rest of the run whole.
BYTE_LEVEL = re.compile(rf" ?{_RUN}|\s+(?!\S)|\s")
#: The same for encoders that drop white space.
WORD_LEVEL = re.compile(_RUN.replace(" ?", ""))
#: Letters that any encoder takes for one word.
_WORD = re.compile(f"[{_LATIN}]{{1,4096}}+")
#: White space for Python but not for the tokenizer library; texts that hold one are not split.
_ODD = "\x1c\x1d\x1e\x1f"


def pieces_of(text: str, pattern: re.Pattern, special: list[str] = ()) -> list[str]:
    """Pieces that encode alone as they do in the text. Special strings are cut out first, as the encoder does."""
    if "<|" in text and (held := [x for x in special if x in text]):
        parts = re.split("(" + "|".join(map(re.escape, sorted(held, key=len, reverse=True))) + ")", text)
        return [p for k, part in enumerate(parts) if part for p in ([part] if k % 2 else pieces_of(part, pattern))]
    return [text] if any(c in text for c in _ODD) else pattern.findall(text)


def load_tokenizer(path: str):
    """A ``tokenizers`` file with truncation and padding off; one thread, as Spark runs tasks side by side."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


#: Steps before the model after which words of Latin letters with blanks between are their lower case, byte by byte.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_PRE_TOKENIZER = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
#: From so many words on it pays to take these steps by a table of letters.
_BY_TABLE = 64


def letters_table(tokenizer) -> tuple[object, dict[int, str]] | None:
    """The model alone, for words with blanks between, and what stands for each Latin letter there; None where the steps before it aren't known."""
    from tokenizers import Tokenizer, pre_tokenizers

    states = [step and json.loads(step.__getstate__()) for step in (tokenizer.normalizer, tokenizer.pre_tokenizer)]
    if states != [{"type": "Sequence", "normalizers": _NORMALIZER}, {"type": "Sequence", "pretokenizers": _PRE_TOKENIZER}]:
        return None
    alone, to_bytes = Tokenizer(tokenizer.model), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    alone.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
    letters = re.findall(f"[{_LATIN}]", "".join(map(chr, range(0x250))))
    return alone, {ord(x): to_bytes.pre_tokenize_str(x.lower())[0][0] for x in letters}


class PieceTokens(dict):
    """piece -> ``keep(ids)``. Unknown pieces are encoded in batches, many to a text, with a special token between.

    A special token ends what stands before it for every step of an encoder, so each piece is encoded as if alone.
    Pieces that may hold a special string are encoded one by one. Where the vocabulary marks the last token of a word, words of Latin
    letters need only a blank between, which takes less time; many at once meet the model alone, where ``letters_table`` knows how. A full
    table starts anew with those of its pieces that were wanted again, or, if these are too many, that are wanted just then.
    """

    def __init__(self, tokenizer, keep: Callable[[np.ndarray], object], limit: int = 1 << 19):
        self.tokenizer, self.keep, self.limit = tokenizer, keep, limit
        self.again: set[str] = set()  # pieces that were wanted again
        special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items() if t.special}
        self.special = list(special)
        self.separator, self.separator_id = max(special.items(), key=lambda x: x[1])
        self.last: np.ndarray | None = None
        self.table = None
        if suffix := getattr(tokenizer.model, "end_of_word_suffix", None):
            ids = tokenizer.get_vocab()
            self.last = np.zeros(max(ids.values()) + 1, bool)
            self.last[[i for token, i in ids.items() if token.endswith(suffix)]] = True
            self.table = letters_table(tokenizer)

    def learn(self, pieces: list[str] | set[str]) -> None:
        """Make sure that all given pieces are in the table; at most some 2**19 at a call."""
        wanted = pieces if isinstance(pieces, set) else set(pieces)
        new = wanted.difference(self)
        known = wanted.difference(new)
        if len(self) + len(new) > self.limit:
            kept = self.again | known  # the frequent ones
            if len(kept) + len(new) > self.limit:
                kept = known
            held = {p: self[p] for p in kept}
            self.clear()
            self.update(held)
            self.again = kept if len(kept) + len(new) < 0.9 * self.limit else set()
        self.again |= known
        lone = [p for p in new if len(p) > 4096 or "<|" in p or not p]
        many = list(new.difference(lone))
        if self.last is not None:
            words = list(filter(_WORD.fullmatch, many))
            many = [*set(many).difference(words), *self._learn_words(words)]
        texts = [self.separator.join(many[i : i + 512]) for i in range(0, len(many), 512)]
        for k, found in enumerate(self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(found.ids, "<u4")
            cuts = np.flatnonzero(ids == self.separator_id)
            starts = np.concatenate(([0], cuts + 1)).tolist()
            ends = [*cuts.tolist(), len(ids)]
            for piece, a, b in zip(many[512 * k : 512 * k + 512], starts, ends, strict=True):
                self[piece] = self.keep(ids[a:b])
        for piece, found in zip(lone, self.tokenizer.encode_batch_fast(lone, add_special_tokens=False), strict=True):
            self[piece] = self.keep(np.array(found.ids, "<u4"))

    def _learn_words(self, words: list[str]) -> list[str]:
        """Words of Latin letters, encoded with a blank between; gives back those of texts in which not each word has one last token."""
        back, parts = [], [words[i : i + 512] for i in range(0, len(words), 512)]
        texts, tokenizer = [" ".join(x) for x in parts], self.tokenizer
        if self.table is not None and len(words) >= _BY_TABLE:
            tokenizer, letters = self.table
            texts = [x.translate(letters) for x in texts]
        for part, found in zip(parts, tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
            if len(ends) != len(part) or ends[-1] != len(ids):
                back += part
                continue
            begins = [0, *ends[:-1]]
            if self.keep is np.ndarray.tobytes:  # to cut bytes takes less time
                raw = ids.tobytes()
                self.update(zip(part, [raw[4 * a : 4 * b] for a, b in zip(begins, ends)]))
            else:
                self.update(zip(part, [self.keep(ids[a:b]) for a, b in zip(begins, ends)]))
        return back
