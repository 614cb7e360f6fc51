"""Draws and sets order the whole pool anew for each seed."""

from hashlib import md5, sha1

from quillspark.operators import assembly, selection

ticket = lambda seed, q: (md5(f"{seed}:{q}".encode()).hexdigest(), q)
POOL = [(str(i), "S" if i % 2 else "T", f"stem number {i} of pool") for i in range(120)]


def _sets(spark):
    pool = spark.createDataFrame(POOL, "question_id string, subject string, stem string")
    blueprint = spark.createDataFrame([(1, "S", 8), (2, "T", 70)], "section int, subject string, wanted int")
    return assembly.build_sets(pool, blueprint, spark.createDataFrame([(s,) for s in "123"], "seed string"))


def _wanted(seed):
    each = [sorted((q for q, s, _ in POOL if s == subject), key=lambda q: ticket(seed, q))[:n] for subject, n in (("S", 8), ("T", 70))]
    return each[0] + each[1]


def test_sets_are_the_first_of_the_whole_order(spark):
    got = {s: [r.question_id for r in sorted(_sets(spark).collect(), key=lambda r: r.number) if r.seed == s] for s in "123"}
    assert got == {s: _wanted(s) for s in "123"}


def test_set_ids_are_those_of_the_whole_order(spark):
    got = {r.seed: r.set_id for r in assembly.set_ids(_sets(spark), "full").collect()}
    assert got == {s: sha1(f"full|{s}|{','.join(_wanted(s))}".encode()).hexdigest() for s in "123"}


def test_quick_sets_are_the_first_of_the_whole_order(spark):
    users = spark.createDataFrame([(1, "S", "7"), (2, "T", "8"), (3, "NONE", "9"), (4, "S", "8")], "user_id long, subject string, seed string")
    missed = spark.createDataFrame([], "user_id long, question_id string")
    got = sorted(map(tuple, selection.quick_set(users, missed, spark.createDataFrame(POOL, "question_id string, subject string, stem string"), 5).collect()))
    want = []
    for u, subject, seed in [(1, "S", "7"), (2, "T", "8"), (3, None, "9"), (4, "S", "8")]:
        first = sorted((q for q, s, _ in POOL if subject in (s, None)), key=lambda q: ticket(seed, q))[:5]
        want += [(u, "subject" if subject else "exam", q, i + 1) for i, q in enumerate(first)]
    assert got == sorted(want)
