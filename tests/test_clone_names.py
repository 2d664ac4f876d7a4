"""Names of clones, however many copies there are."""

from atollkit.operators import projects as pu


def test_first_free_name(spark):
    names = ["a"] + ["a" + "_copy" * k for k in range(1, 31)] + ["b", "b_copy", "b_copy_copy_copy", "c", "_copy", None, "b_copyx"]
    projects = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    got = {names[r.id]: r.name for r in pu.clone_names(projects, projects.select("id")).collect()}
    want = {}
    for n in names:
        new = n
        while n is not None and new in names:
            new += "_copy"
        want[n] = new
    assert got == want
