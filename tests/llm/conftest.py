from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, D_Note string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (id, text) or (id, text, lang, source), in several partitions, with a column of its own."""

    def build(rows, parts: int = 3):
        full = [(*r, *("en", "s")[len(r) - 2 :], 0, "x") if len(r) < 4 else (*r, 0, "x") for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(parts)

    return build


#: Empty, blank, null and repeated rows, and rows without an id.
ODD = [(900, ""), (901, None), (902, " \n\t"), (903, "same words here again"), (903, "same words here again"), (None, "same words here again"), (None, None)]
