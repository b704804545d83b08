"""Terms contained in subjects: the automaton against the join and against one by one."""

import random
import time

from noticeflow.functions import category


def test_automaton_like_the_join(spark):
    rnd = random.Random(1)
    word = lambda n: "".join(rnd.choice("abc叉车") for _ in range(n))
    terms = [(i // 3, i % 3, word(rnd.randint(1, 5))) for i in range(80)] + [(99, 0, "😀"), (100, 0, "")]
    table = spark.createDataFrame(terms, "row_no int, term_pos int, term string")
    subjects = [(i, word(rnd.randint(0, 20))) for i in range(200)] + [(900, None), (901, "x😀y"), (902, "zzz")]
    df = spark.createDataFrame(subjects, "k int, subject string")
    want = {}
    for k, s in subjects:
        inside = [(-len(t), r, p, t) for r, p, t in terms if t and s is not None and t in s]
        want[k] = min(inside)[3] if inside else None
    got = {r.k: r.matched_term for r in category.contained_term(df, table, "k").collect()}
    joined = {r.k: r.matched_term for r in category.contained_term(df, table, "k", automaton_bytes=1).collect()}
    assert got == joined == want and None in want.values()
    assert {r.matched_term for r in category.contained_term(df, table.limit(0), "k").collect()} == {None}


def test_many_terms_in_linear_time():
    terms = sorted({f"term{i:06}" for i in range(100_000)}, key=lambda t: (-len(t), t))
    run = category.first_contained(terms)
    import pandas as pd

    text = " ".join(f"x{i % 7}term{i % 100_000:06}y" for i in range(50_000))
    start = time.time()
    (found,) = run(iter([pd.Series([text, "nothing here", None])]))
    assert found.tolist() == ["term000000", None, None] and time.time() - start < 20
