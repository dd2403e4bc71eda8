"""Tables in the shared folder."""

import os

from chatlake.sources.shared import clear, forget, new_path, written


def test_clear(spark):
    clear(spark)
    a, b = written(spark.range(3), "a"), written(spark.range(4), "b")
    where = [x._written_to.removeprefix("file://") for x in (a, b)]
    stream = new_path(spark, "stream")
    assert all(map(os.path.isdir, where)) and (a.count(), b.count()) == (3, 4) and "stream-" in stream
    forget(a)
    assert [os.path.isdir(x) for x in where] == [False, True]
    assert clear(spark) == 2 and not os.path.isdir(where[1]) and clear(spark) == 0
