"""The same words and prose for all tests of this folder."""

import random
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def prose(seed, n, names=400):
    r = random.Random(seed)
    lexicon = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 7))) + str(i) for i in range(names)]
    return " ".join(r.choice(lexicon) for _ in range(n))
