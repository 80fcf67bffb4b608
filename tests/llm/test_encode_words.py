"""New words are encoded together, not one call each, and equal the tokenizer's ids of each."""

import random

import public_tokenizers as public

from quantloom.llm import packing, token_alignment

ODD = ["<s>", "</s>", "a\nb", "it's", "x y", "​z", "▁q", "Été", "12,5", "***", "日本語", "é", "\U0001f600!", "a" * 200]


def made_words(n):
    rng = random.Random(5)
    return [*ODD, *{"".join(rng.choice("aeioulnrst.,") for _ in range(rng.randint(1, 9))) for _ in range(n)}]


def test_words_taken_together_have_their_own_ids():
    words, encoder = made_words(3000), packing.WordEncoder(public.path("byte_bpe_50k.json"))
    assert packing.encode_words(encoder.tokenizer, encoder.leading, words) == encoder._encode([" " + w for w in words])
    spaced = ["a", "b c", "d"]  # isn't a word: each is encoded alone
    assert packing.encode_words(encoder.tokenizer, encoder.leading, spaced) == encoder._encode([" " + w for w in spaced])


class Counting:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, inner):
        self.inner, self.texts = inner, 0

    def __getattr__(self, name):
        return getattr(self.inner, name)

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.inner.encode_batch_fast(texts, **options)


def test_new_words_cost_few_texts():
    words = [w for w in made_words(3000) if len(w) <= token_alignment.MEMO_WORD]
    pair = token_alignment.TokenPair(public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model"))
    one_by_one = [None if b"" in sides else sides for sides in pair._encode(words)]
    pair.a = Counting(pair.a)
    (coded,) = pair.encode([" ".join(w for w, sides in zip(words, one_by_one, strict=True) if sides)])
    assert pair.a.texts < len(words) / 50
    assert [x.astype("uint32").tobytes() for x in coded] == [b"".join(side) for side in zip(*filter(None, one_by_one), strict=True)]
    assert None in one_by_one and pair.encode([words[one_by_one.index(None)]]) == [None]
