"""op10: hidden spellings of any length and in combination."""

import numpy as np
import pytest

from sparkgauge.llm import toxicity

WORDS = "you are a stupid idiot and this is total trash for all of the good people that book it".split()


@pytest.fixture(scope="module")
def chars():
    counts = np.zeros((toxicity.SYMBOLS,) * 3)
    for word in WORDS:
        row = [0, 0, *(ord(c) - 96 for c in word), 0]
        for k in range(2, len(row)):
            counts[row[k - 2] if row[k - 1] else 0, row[k - 1], row[k]] += 50
    return toxicity.char_model(counts.ravel())


def restored(text, chars):
    return toxicity.restore(text, chars, {}).split()


@pytest.mark.parametrize("text", [
    "you,1d10t,stup1d,tr4sh,are,good,people,and,that,is,all",
    "<b>you</b><i>1d10t</i><b>stup1d</b>(tr4sh)[good]{people}",
    "https://good/people/of/the/1d10t/stup1d/tr4sh/and/more/book",
])
def test_leetspeak_in_long_tokens(chars, text):
    out = toxicity.restore(text, chars, {})
    assert len(text) > 40
    assert {"idiot", "stupid", "trash"} <= set("".join(c if c.isalpha() else " " for c in out).split())


def test_words_stretched_past_any_length(chars):
    for n in (50, 5000):
        assert restored(f"you idi{'o' * n}t", chars) == ["you", "idiot"]


@pytest.mark.parametrize("text", [
    "i d i o t", "1 d 1 0 t", "i d 1 o t", "i.d.1.0.t", "i  d  i  o  t", "i - d - i - o - t",
    "i\t1\td.*0 t".replace("1\td", "d\t1"), "1.d.1.0t", "i,d,1,0,t", "i_d_1_o_t !", "iiddiioott", "11dd1100tt",
])
def test_spaced_leetspeak_and_doubled_letters(chars, text):
    out = restored(f"you {text} book", chars)
    assert (out[0], out[1], out[-1]) == ("you", "idiot", "book")


def test_wider_gaps_between_spaced_words(chars):
    assert restored("y 0 u   1 d 1 0 t", chars) == ["you", "idiot"]


@pytest.mark.parametrize("text", ["1 0 1 0 7", "10 - 20 - 30", "good people book it", "the 5 people"])
def test_numbers_and_plain_words_stay(chars, text):
    assert toxicity.restore(text, chars, {}) == text
