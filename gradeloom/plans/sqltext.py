"""SQL text shared by the oracles: seeded draws and the bootstrap built on them."""

from gradeloom.functions.hashing import MODULUS, poisson_cuts


def _hashed(source: str, b: str, i: str, seed: int) -> str:
    """`source` rows plus column x2, computed step by step."""
    p = MODULUS
    return (f"SELECT *, ((x1 * x1) % {p} + x1 * 48271) % {p} AS x2 FROM (SELECT *, ((x0 * x0) % {p} + x0 * 16807 + "
            f"({i})::BIGINT * 99991) % {p} AS x1 FROM (SELECT *, (({b})::BIGINT * 40014 + ({i})::BIGINT * 40692 + {seed}) % {p} AS x0 "
            f"FROM ({source})))")


def text_key(expr: str) -> str:
    return f"('0x' || substr(md5({expr}), 1, 8))::BIGINT"


def bootstrap(prefix: str, source: str, keys: str, value: str, unit: str, replicates: int, seed: int,
              exact: bool = False, count: str = "1", alpha: float = 0.05) -> str:
    """CTEs ending in `{prefix}_ci` with the keys, n, point, lo, hi."""
    low, high = int(alpha / 2 * replicates), min(int((1 - alpha / 2) * replicates), replicates - 1)
    p = prefix
    if exact:
        draws = _hashed(f"SELECT {keys}, n_units, b, i FROM (SELECT {keys}, count(*) AS n_units FROM {p}_u GROUP BY {keys}), "
                        f"range({replicates}) r(b), LATERAL (SELECT unnest(range(n_units)) AS i)", "b", "i", seed)
        reps = (f"SELECT {', '.join('d.' + k.strip() for k in keys.split(','))}, d.b, sum(u.s) / sum(u.c) AS mean "
                f"FROM ({draws}) d JOIN {p}_u u ON "
                + " AND ".join(f"u.{k.strip()} = d.{k.strip()}" for k in keys.split(","))
                + f" AND u.idx = d.x2 % d.n_units GROUP BY ALL")
    else:
        hashed = _hashed(f"SELECT {keys}, s, c, b, {text_key('unit')} AS kk FROM {p}_u, range({replicates}) r(b)", "b", "kk", seed)
        weight = " + ".join(f"(x2 >= {cut})::INT" for cut in poisson_cuts())
        reps = f"SELECT {keys}, b, sum(w * s) / sum(w * c) AS mean FROM (SELECT *, {weight} AS w FROM ({hashed})) WHERE w > 0 GROUP BY ALL"
    return f"""
{p}_u AS (SELECT {keys}, ({unit})::VARCHAR AS unit, ({value})::DOUBLE AS s, ({count})::BIGINT AS c,
   row_number() OVER (PARTITION BY {keys} ORDER BY ({unit})::VARCHAR) - 1 AS idx FROM {source} WHERE ({value}) IS NOT NULL),
{p}_reps AS ({reps}),
{p}_ci AS (SELECT g.*, coalesce(b.lo, g.point) AS lo, coalesce(b.hi, g.point) AS hi FROM
   (SELECT {keys}, sum(c)::BIGINT AS n, sum(s) / sum(c) AS point, count(*) AS units FROM {p}_u GROUP BY {keys}) g LEFT JOIN
   (SELECT {keys}, list_sort(list(mean))[{low + 1}] AS lo, list_sort(list(mean))[{high + 1}] AS hi FROM {p}_reps GROUP BY {keys}) b
   USING ({keys}))"""
