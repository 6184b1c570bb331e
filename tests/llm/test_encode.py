"""Cut and kept words give the ids of the whole text."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trialwright.llm import store
from trialwright.llm.encode import Encoder

ODD = ["a.\nb", "a. b.", "x.,", "x...", "x..\ny", "1.5, 2.", "é.", "é. z", "A.B. c", "a.\n\nb", "a. \nb", "\na", "a\n", "a.\n", "don't. I'll,", "it's.\nwe've",
       "a\t.b", "Σ. ΑΣ.\nx", "3.\n4", "a,\nb, c", "x \x0b y", "a\r\nb", "a .\nb", "", " ", "AΣ. b", "the<|endoftext|>.\n", "NUL\0. x"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_odd_texts(name):
    draw = random.Random(1)
    texts = ODD + ["".join(draw.choice(["a", "B", "é", ".", ",", "\n", " ", "1", "'s", "x", "İ", " ", "-"]) for _ in range(draw.randrange(1, 14))) for _ in range(1500)]
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    for text, ids in zip(texts, Encoder(public_tokenizers.path(name))(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("most, width", [(65_535, 2), (65_536, 4)])
def test_shards_of_either_width(tmp_path, most, width):
    documents = [np.array(ids, "<u4").tobytes() for ids in ([1, most], [], [3])]
    path = f"{tmp_path}/one.tok"
    store.write_shard(path, documents)
    places, ids = store.read_shard(path)
    assert places.tolist() == [0, 2, 2, 3] and ids.tolist() == [1, most, 3] and ids.dtype == np.uint32
    assert [store.read_ids(path, k).tolist() for k in range(3)] == [[1, most], [], [3]]
    assert (tmp_path / "one.tok").stat().st_size == 24 + 4 * 8 + 3 * width


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_letters_and_punctuation(name):
    draw = random.Random(2)
    letters = [chr(i) for i in range(0x41, 0x300) if chr(i).isalpha()] + ["ŉ", "İ", "ẞ", "ſ", "K", "ª", "漢", "Ⅷ", "²", "٣"]
    signs = list("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") + ["̸", "́", "̇", "\n", " ", "\xa0", "\x1c", "\t", "…", "​"]
    texts = ["é###.\nÄb", "x≠ y", "x.́", "İ. İ", "a'.\nb", "don't## it's", "a\nb\n\nc\n", "\n's", "_a_ b_", "x.'", "Ɗț Ⱥ Ⱥ."]
    texts += ["".join(draw.choice(letters if draw.random() < 0.6 else signs) for _ in range(draw.randrange(1, 24))) for _ in range(3000)]
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    for text, ids in zip(texts, Encoder(public_tokenizers.path(name))(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_known_letters_are_not_encoded_again(name, monkeypatch):
    encoder, asked = Encoder(public_tokenizers.path(name)), []
    list(encoder(["a zürqux. b## \n c,\nd%% e\nf"]))
    for how in ("_together", "_whole"):
        monkeypatch.setattr(encoder, how, lambda words, to=getattr(encoder, how): asked.extend(words) or to(words))
    list(encoder(["a zürqux## zürqux, zürqux.\nd"]))
    assert not asked
