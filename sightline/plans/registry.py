"""Where queries register themselves with their SQL."""

from __future__ import annotations

from ..sources import testdata

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: A percentage with one digit, half up, as text.
TENTHS = "((2000 * {a} + {b}) // (2 * {b}) // 10) || '.' || ((2000 * {a} + {b}) // (2 * {b}) % 10) || '%'"


def query(sql: str | None = None, views: bool = True):
    """Registers a function (spark, sf_dir) under its name; `views` puts the test-data views before its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            head = f"WITH {testdata.SQL}" if views else ""
            ORACLES[f.__name__] = (head + ("," if views and sql.lstrip().startswith("--cte") else "") + sql.replace("--cte", "", 1)).replace("$WINDOW", str(testdata.WINDOW) + "::BIGINT")
        return f

    return add
