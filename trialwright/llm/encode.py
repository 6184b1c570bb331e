"""Token ids of whole texts, by a public tokenizer, with the ids of words kept for the next time they occur."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from trialwright.llm.kernels import worker_cache

# Words whose ids a worker keeps.  When there are more, it starts anew.
MOST_WORDS = 1_000_000
# Characters of text whose words are looked up at once.
CHUNK = 1 << 20
# A run of white space that would fall apart differently if texts were cut at its spaces.
_TANGLED = re.compile(r"\s \s")
# Letters that every Unicode version takes for letters, that NFC leaves alone and whose lower case is one letter.
_LETTER = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-įı-ɏ"
# Pieces that both tokenizers set apart: punctuation between such a letter or an ASCII digit and the end of a word, and a
# single line end between two words.
_CUT = re.compile(rf"((?<=[{_LETTER}0-9])[!-&(-/:-@\[-`{{-~]+(?=\n\S|\Z)|(?<=\S)\n(?=\S))")
_LETTERS = re.compile(f" ?[{_LETTER}]+")
# A word that is not expected in texts, to find the ends of words encoded together.  Where it does occur, they go one by one.
_MARK = " \x02"


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers.

    Both tokenizers used here cut a text into pieces before they merge, and no piece reaches over a single space into
    the word after it.  A text is therefore cut before each space, and only words not seen yet go to the library, cut again
    before punctuation that ends a word and around a single line end.  What then is letters only is one piece and goes to the
    library's model as such.  Where the tokenizer takes no notice of case, A-Z are lower-cased first.  Texts with white space
    of three or more characters around a space, with a special token or a NUL in them, go there whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        cache = worker_cache("encoders")
        if path not in cache:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
            mark, upper, lower = (tokenizer.encode(t, add_special_tokens=False).ids for t in (_MARK, "THE QUICK", "the quick"))
            cache[path] = tokenizer, tokenizer.model, {}, special, mark, upper == lower, _byte_letters(tokenizer)
        self.tokenizer, self.model, self.words, self.special, self.mark, self.caseless, self.letters = cache[path]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters only, each one piece to the tokenizer."""
        found = [[t.id for t in self.model.tokenize((w.lower() if self.caseless else w).translate(self.letters))] for w in words]
        return _cut_ids(np.array(list(chain.from_iterable(found)), "<u4"), np.fromiter(map(len, found), np.int64, len(found)))

    def _together(self, words: list[str]) -> list[bytes]:
        """Ids of words that begin with a space, encoded as one text with marks between."""
        ids = np.array(self.tokenizer.encode_batch_fast([_MARK.join(words)], add_special_tokens=False)[0].ids, "<u4")
        n = len(self.mark)
        at = np.flatnonzero(ids == self.mark[0])
        if n > 1:
            at = at[at <= len(ids) - n]
            at = at[np.all([ids[at + i] == x for i, x in enumerate(self.mark)], axis=0)]
        if len(at) != len(words) - 1:
            return self._whole(words)
        data, edges = ids.tobytes(), at.tolist()
        return [data[4 * a:4 * b] for a, b in zip([0, *[x + n for x in edges]], [*edges, len(ids)])]

    def _learn(self, new: list[str]) -> None:
        letters = {w for w in new if _LETTERS.fullmatch(w)}
        cut = {w: _CUT.split(w) for w in new if w not in letters}
        parts = set(chain.from_iterable(cut.values())).difference(self.words)
        letters.update(w for w in parts if _LETTERS.fullmatch(w))
        self._encode(list(letters), [w for w in parts if w not in letters])
        self.words.update((w, b"".join(map(self.words.__getitem__, p))) for w, p in cut.items() if len(p) > 1)

    def _encode(self, letters: list[str], others: list[str]) -> None:
        plain, rest = [], []
        for w in others:
            (plain if w[:1] == " " and len(w) > 1 and not w[-1].isspace() else rest).append(w)
        for part, how in ((letters, self._pieces), (plain, self._together), (rest, self._whole)):
            for a in range(0, len(part), 2000):
                self.words.update(zip(part[a:a + 2000], how(part[a:a + 2000])))

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        whole = {i: t for i, t in enumerate(texts) if "\0" in t or _TANGLED.search(t) or any(s in t for s in self.special)}
        size, start = 0, 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= CHUNK or i + 1 == len(texts):
                ids = self._chunk(["" if j in whole else texts[j] for j in range(start, i + 1)])
                yield from (self._whole([whole[j]])[0] if j in whole else ids[j - start] for j in range(start, i + 1))
                size, start = 0, i + 1

    def _chunk(self, texts: list[str]) -> list[bytes]:
        column = pa.array(texts, pa.large_string())
        column = pc.ascii_lower(column) if self.caseless else column
        cut = pc.split_pattern(pc.replace_substring(column, " ", "\0 "), "\0")
        words = cut.flatten().dictionary_encode()
        different = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.words) > MOST_WORDS:
            self.words.clear()
        found = list(map(self.words.get, different))
        new = [i for i, ids in enumerate(found) if ids is None]
        self._learn([different[i] for i in new])
        for i in new:
            found[i] = self.words[different[i]]
        # Each text's ids are those of its words, one after another.
        which = words.indices.to_numpy()
        ids, sizes = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        begin, n = np.append(0, np.cumsum(sizes))[which], sizes[which]
        places = np.append(0, np.cumsum(n))
        ids = ids[np.repeat(begin - places[:-1], n) + np.arange(places[-1])]
        return _cut_ids(ids, np.diff(places[cut.offsets.to_numpy()]))


def _byte_letters(tokenizer) -> dict[int, str]:
    """The byte symbols that the library's models know letters by, and what becomes of a space before them."""
    from tokenizers.pre_tokenizers import ByteLevel

    symbols = ByteLevel(add_prefix_space=False, use_regex=False)
    letters = [c for c in map(chr, range(0x250)) if c != " " and _LETTERS.fullmatch(c)]
    table = {ord(c): symbols.pre_tokenize_str(c)[0][0] for c in (*letters, *map(str.lower, letters))}
    return table | {ord(" "): tokenizer.pre_tokenizer.pre_tokenize_str(" a")[0][0][:-1]}


def _cut_ids(ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    data, edges = ids.tobytes(), (4 * np.append(0, np.cumsum(sizes))).tolist()
    return [data[a:b] for a, b in zip(edges, edges[1:])]
