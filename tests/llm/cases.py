"""Documents with the cases that every operator must bear."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, spans int, f int, score double, word string, row int"


def texts(seed=0):
    own = random.Random(seed)
    vocabulary = ["".join(own.choice(["ta", "re", "no", "li", "su", "é", "ß"]) for _ in range(own.randint(1, 4))) for _ in range(300)]
    speak = lambda n: " ".join(own.choice(vocabulary) for _ in range(n))
    passage = speak(90)
    long = speak(6000)
    made = [
        None, "", " \n\t ", "a", "A  b\tc", "...!!", "x" * 3000, "no " * 700, "éß漢😀" * 200, long,
        long[:9000] + " changed " + long[9000:], passage, passage, passage + ".", "All rights reserved. CC BY cc-by GNU General Public License",
        "\x00nul \x0bv\x0cf\x1fu\x85n\xa0b", "▁▁ a▁b  ", passage.upper(),
    ]
    for i in range(60):
        words = speak(own.randint(20, 160)).split()
        if i % 3 == 0:
            at = own.randint(0, len(words))
            words[at:at] = passage.split()
        if i % 7 == 0:
            words = made[-1].split() if made[-1] else words
            words[own.randint(0, len(words) - 1)] = "edited"
        made.append(" ".join(words))
    return made


def rows(seed=0):
    made = texts(seed)
    out = [(i, t, None if i % 5 == 0 else "abc"[i % 3], None, None, "kept", 1, 2, 0.5, "w", 3) for i, t in enumerate(made)]
    more = [
        (len(made) - 1, made[-1], "a", None, None, None, None, None, None, None, None),  # a repeated row
        (3, "another text of one id", None, None, None, None, None, None, None, None, None),
        (None, made[20], "b", None, None, None, None, None, None, None, None),
        (None, None, None, None, None, None, None, None, None, None, None),
    ]
    return out + more


def documents(spark, seed=0):
    return spark.createDataFrame(rows(seed), SCHEMA).repartition(3)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
