"""Word-by-word ids against those of the whole text."""

import random

import public_tokenizers

from patchloom.llm.packing import END_ID, WordTokenizer

ALPHABET = "aAbBzZ 0129'.,!?<|>_-\n\t\xa0 éÉßÿÞ×÷ªºµ́ÅİKΣςж中 $"
HARD = ["I'll don't we've x's !'s 'S", "<|endoftext|> a<|startoftext|>b", "İstanbul K Å ẞ", "é É", None, "", " \n ", "x" * 5000]


def test_word_ids_equal_whole_text():
    words = WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    assert words.parts is not None
    rng = random.Random(7)
    texts = HARD + ["".join(rng.choices(ALPHABET, k=rng.randint(0, 60))) for _ in range(3000)]
    ids, counts, _, _ = words.encode(texts)
    at = 0
    for text, n in zip(texts, counts.tolist(), strict=True):
        assert ids[at : at + n].tolist() == [*words.tokenizer.encode(text or "", add_special_tokens=False).ids, END_ID], text
        at += n


def test_other_tokenizers_take_the_general_path():
    assert WordTokenizer(public_tokenizers.path("byte_bpe_50k.json")).parts is None
