import hashlib
import random

from hypothesis import given
from hypothesis import strategies as st

from voxloom.llm.shared import first_by_hash, whole_words


def test_first_by_hash(spark):
    draw = random.Random(1)
    rows = [(i, draw.choice("aaaab")) for i in range(9000)] + [(9001, "c"), (9002, "c")]
    table = spark.createDataFrame(rows, "doc_id long, lang string")
    for k in (1, 7, 3000):
        found = {(r.doc_id, r.lang) for r in first_by_hash(table, "lang", k).collect()}
        wanted = set()
        for lang in "abc":
            ids = [i for i, name in rows if name == lang]
            ids.sort(key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
            wanted |= {(i, lang) for i in ids[:k]}
        assert found == wanted


@given(st.text(alphabet="ab é\n\t\x0b\x1c\u00a0", max_size=60), st.integers(1, 20))
def test_words_do_not_depend_on_blocks(text, size):
    data = text.encode()
    assert [w for block in whole_words(data, size) for w in block] == data.split()
