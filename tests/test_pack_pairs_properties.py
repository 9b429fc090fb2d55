"""Packing and pair construction vs small sequential Python models written
"""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from labelspark.operators import pack as PK
from labelspark.operators import pairs as P

SETTINGS = settings(max_examples=12, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])
WORD = st.sampled_from(["a", "bb", "c", "dd", "e"])


def model_pack(text_tokens, labels, max_length):
    tt = text_tokens[:max_length]
    lt = [l.split()[:128] for l in labels]
    if len(tt) + sum(len(x) + 1 for x in lt) + 2 > max_length:
        avail = max_length - 2
        tb = max(avail // 2, 10)
        budget = avail - tb
        tt = tt[:tb]
        kept, used = [], 0
        for x in lt:
            if used + len(x) + 1 > budget:
                break
            kept.append(x)
            used += len(x) + 1
        lt = kept
    seq, mask = ["[CLS]"] + tt + ["[SEP]"], [0] * (len(tt) + 2)
    for i, x in enumerate(lt, start=1):
        seq += x + ["[LAB]"]
        mask += [i] * len(x) + [0]
    return seq, mask, len(lt)


@SETTINGS
@given(st.lists(st.tuples(st.lists(WORD, max_size=40),
                          st.lists(st.lists(WORD, min_size=1, max_size=6).map(" ".join),
                                   max_size=6)), min_size=1, max_size=6),
       st.sampled_from([16, 24, 40]))
def test_pack_matches_model(spark, rows, max_length):
    df = spark.createDataFrame([(i, " ".join(t), ls, [1] * len(ls)) for i, (t, ls) in enumerate(rows)],
                               "sample_id long, text string, ltext array<string>, lint array<int>")
    got = {r.sample_id: (r.input_tokens, r.lmask, r.n_fit)
           for r in PK.pack(df, max_length).collect()}
    for i, (t, ls) in enumerate(rows):
        assert got[i] == model_pack(t, ls, max_length)


@SETTINGS
@given(st.lists(st.tuples(st.lists(WORD, min_size=1, max_size=3),
                          st.lists(WORD, max_size=4)), min_size=1, max_size=12))
def test_contrastive_cycle_matches_sequential_loop(spark, rows):
    df = spark.createDataFrame([(i, f"t{i}", p, n) for i, (p, n) in enumerate(rows)],
                               "sample_id long, text string, labels array<string>, "
                               "not_labels array<string>")
    got = sorted((r.sample_id, r.pos, r.positive, r.negative)
                 for r in P.contrastive_pairs(df.repartition(3)).collect())
    want, n = [], 0
    for i, (p, neg) in enumerate(rows):
        if not neg:
            continue
        for j, lab in enumerate(p):
            n += 1
            want.append((i, j, lab, neg[(n - 1) % len(neg)]))
    assert got == sorted(want)
