import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, h string, row int, n string, spans string, part int, whole string"


def words(r: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{r.randrange(vocabulary)}{'x' * r.randrange(4)}" for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """Copies, near copies, shared passages, nulls, empty and long texts, repeated rows; extra columns with common names."""
    r = random.Random(5)
    passage, out = words(r, 70), []
    for i in range(60):
        w = words(r, r.choice([3, 12, 60, 150, 300]))
        if i % 5 == 0:
            at = r.randrange(len(w))
            w[at:at] = passage[: r.choice([49, 50, 70])]
        out.append((i + 1, " ".join(w)))
    base = words(r, 200)
    for i in range(12):
        w = list(base)
        for _ in range(i):
            w[r.randrange(len(w))] = f"e{i}"
        out.append((100 + i, " ".join(w)))
    out += [(200 + i, out[7][1]) for i in range(3)] + [(210, out[8][1].replace(" ", " \n\t"))]
    out += [(220, None), (221, ""), (222, " \n "), (223, "one"), (224, "ONE"), (225, "12 34 !"), (226, " ".join(words(r, 9000))), (227, "Été über ñandú   á 'S it's <|endoftext|> 99")]
    out += [(230, "under the MIT License and the GNU General Public License, CC-BY"), (231, "mit license mit license cc by nc"), (232, "Permission is hereby granted, free of charge, to any person getting a copy of this software and associated documentation files (the Software), to deal in the Software without restriction")]
    out += [out[3], out[3], (None, "no id at all " * 20), (None, None)]
    langs, sources = ["en", "de", None], ["a", "b", "Z", None, "long tail"]
    return [(d, t, langs[i % 3], sources[i % 5 if i % 7 else 0], None, "h", 1, "n", "s", 2, "w") for i, (d, t) in enumerate(out)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
