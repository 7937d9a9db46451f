import random

from pyspark.sql import functions as F

from codequarry.operators import attempts


def plain(log):
    """(place of the request's first attempt, attempt, state, wait) along one key."""
    out, first, tries = [], 1, 0
    for at, (ok, status, error) in enumerate(log, 1):
        error, tries = (error or "").lower(), tries + 1
        again = "insufficient credits" not in error and (status is None or status in (408, 409, 429) or status >= 500)
        state = "ok" if ok else "refused" if not again else "gave_up" if tries == 5 else "retried"
        limited = status == 429 or any(x in error for x in ("rate limit", "rate_limit", "too many requests", "429"))
        wait = None if state != "retried" else min(120, 15 * 2 ** (tries - 1)) if limited else 2**tries
        out.append((first, tries, state, wait))
        if state != "retried":
            first, tries = at + 1, 0
    return out


def test_requests_by_hand_rule(spark):
    rng = random.Random(3)
    kinds = [(True, 200, None), (False, 500, None), (False, 503, "Rate limit reached"), (False, 429, None), (False, 404, None), (False, None, "timed out"), (False, 408, None), (False, None, "Insufficient credits"), (None, 529, "x")]
    logs = {1: [rng.choice(kinds) for _ in range(300)], 2: [kinds[1]] * 23, None: [kinds[5]] * 3, 3: [kinds[0]]}
    rows = [(k, i, *x) for k, log in logs.items() for i, x in enumerate(log)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "key int, n int, ok boolean, status int, error string").repartition(4)
    got = {}
    for r in sorted(attempts.requests(df, ("key",), ("n",)).collect(), key=lambda r: r.n):
        got.setdefault(r.key, []).append((r["first"], r.attempt, r.state, r.wait))
    assert got == {k: plain(log) for k, log in logs.items()}


def test_back_off_is_bounded(spark):
    row = spark.range(1).select(*[attempts.back_off(F.lit(n), F.lit(429), F.lit(None).cast("string")) for n in (1, 4, 9)]).first()
    assert tuple(row) == (15, 120, 120)
