"""Values that lie at a threshold fall on the side that SQL puts them on."""

import random

import duckdb

from test_catalog import plain

from tidemark.plans import catalog, sensors  # noqa: F401


def test_deviations_of_exactly_the_threshold(spark, tmp_path):
    """Devices whose last window of two or four readings, in cents, has a deviation of 30: rounding decides, in the order of the rows."""
    random.seed(5)
    rows = []
    for user in range(3000):
        shifts = random.choice([(0, 6000), (0, -6000), (0, 0, 6000, 6000), (0, 6000, 6000, 0), (0, 6000, 0, 6000)])
        low = random.randrange(6000, 15000)
        rows += [(user * 4 + i, user, (low + s) / 100, i * 50_000) for i, s in enumerate(shifts)]
    folder = tmp_path / "at30"
    folder.mkdir()
    con = duckdb.connect()
    con.execute("CREATE TABLE r (event_id BIGINT, user_id BIGINT, value DOUBLE, s BIGINT)")
    con.execute("INSERT INTO r VALUES " + ", ".join(map(str, rows)))
    con.execute(f"COPY (SELECT event_id, TIMESTAMP '2024-01-01' + s * INTERVAL 1 SECOND AS ts, user_id, 'click' AS event_type, value, '{{}}' AS props FROM r) TO '{folder}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    found = plain(tuple(r) for r in catalog.QUERIES["stillness_timer"](spark, str(folder)).collect())
    wanted = plain(con.execute(catalog.ORACLE_SQL["stillness_timer"]).fetchall())
    assert found == wanted
