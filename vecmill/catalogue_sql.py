"""DuckDB SQL for the catalogue's queries, put together from common table expressions."""

from __future__ import annotations

K, ROUNDS = 16, 3
V = "v AS MATERIALIZED (SELECT CAST(vec_id AS BIGINT) AS id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"
HALF = "half AS (SELECT count(*) // 2 AS h, count(*) - count(*) // 2 AS r FROM v)"
DIST = {"l2": "list_distance({0}, {1}) ** 2", "ip": "-list_inner_product({0}, {1})"}
SOURCES = {
    "v": "src AS (SELECT id, vec FROM v)",
    "first": "src AS (SELECT id, vec FROM v, half WHERE id < h)",
    "live": "src AS (SELECT id, vec FROM v, half WHERE id < h OR id - h >= r // 10)",
}


def near(name: str, table: str, cents: str, metric: str = "l2") -> str:
    """name: id, vec, cluster, d of each row of table."""
    d = DIST[metric].format("t.vec", "c.centroid")
    return f"{name} AS MATERIALIZED (SELECT id, vec, n.c AS cluster, n.d AS d FROM (SELECT t.id, any_value(t.vec) AS vec, min(struct_pack(d := {d}, c := c.cluster)) AS n FROM {table} t, {cents} c GROUP BY t.id))"


def means(name: str, assigned: str, cents: str, unit: bool = False) -> str:
    """name: cluster, centroid after averaging; a cluster without members keeps its own."""
    new = "list_transform(m, lambda x: x / CASE WHEN n = 0 THEN 1 ELSE n END)" if unit else "m"
    own = "CASE WHEN n > 0 THEN {} END".format(new) if unit else new
    return f"""{name} AS MATERIALIZED (
  SELECT c.cluster, coalesce({own}, c.centroid) AS centroid FROM {cents} c LEFT JOIN (
    SELECT cluster, m, sqrt(list_inner_product(m, m)) AS n FROM (
      SELECT cluster, list(x ORDER BY pos) AS m FROM (
        SELECT cluster, pos, (CAST(sum(CAST(floor(x * 1e9 + 0.5) AS BIGINT)) AS DOUBLE) / 1e9) / count(*) AS x
        FROM (SELECT cluster, unnest(vec) AS x, generate_subscripts(vec, 1) AS pos FROM {assigned}) GROUP BY cluster, pos)
      GROUP BY cluster)) s USING (cluster))"""


def lloyd(metric: str = "l2", unit: bool = False) -> list[str]:
    out = [f"c0 AS (SELECT row_number() OVER (ORDER BY id) - 1 AS cluster, vec AS centroid FROM (SELECT * FROM src ORDER BY id LIMIT {K}))"]
    for i in range(ROUNDS):
        out += [near(f"a{i}", "src", f"c{i}", metric), means(f"c{i + 1}", f"a{i}", f"c{i}", unit)]
    return out


STAT = """stat AS MATERIALIZED (
  SELECT cluster, n, a, list_inner_product(a, a) AS s FROM (SELECT cluster, count(*) AS n FROM post GROUP BY cluster) JOIN (
    SELECT cluster, list(x ORDER BY pos) AS a FROM (
      SELECT cluster, pos, CAST(sum(CAST(floor(x * 1e9 + 0.5) AS BIGINT)) AS DOUBLE) / 1e9 AS x
      FROM (SELECT cluster, unnest(vec) AS x, generate_subscripts(vec, 1) AS pos FROM post) GROUP BY cluster, pos)
    GROUP BY cluster) USING (cluster))"""


def joined(ctes: list[str], body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(ctes) + "\n" + body


def base(source: str = "v", metric: str = "l2") -> list[str]:
    """v, src, c0 to c3 (by L2), and post: the assignment to c3 by the metric."""
    return [V, HALF, SOURCES[source], *lloyd(), near("got", "src", f"c{ROUNDS}", metric), "post AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY id) - 1 AS pos FROM got)"]


def index(body: str, source: str = "v", metric: str = "l2", stats: bool = False) -> str:
    return joined(base(source, metric) + [STAT] * stats, body)


def exact(metric: str, live: bool = False) -> str:
    d = DIST[metric].format("q.vec", "t.vec")
    ranked = f"SELECT q.id AS qid, t.id, {d} AS d, row_number() OVER (PARTITION BY q.id ORDER BY {d}, t.id) AS rank FROM v q, src t WHERE q.id % 50 = 0"
    return joined([V, HALF, SOURCES["live" if live else "v"]], f"SELECT qid, rank, id, round(d, 6) + 0.0 AS distance FROM ({ranked}) WHERE rank <= 10")


UNIT = joined([V, "w AS (SELECT id, list_transform(vec, lambda x: x * (id % 7)) AS w FROM v)", "n AS (SELECT id, w, sqrt(list_inner_product(w, w)) AS n FROM w)"], "SELECT id, unnest(range(len(w))) AS pos, round(unnest(list_transform(w, lambda x: x / CASE WHEN n = 0 THEN 1 ELSE n END)), 9) + 0.0 AS x FROM n")
STANDARD = joined([V, "e AS (SELECT id, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS pos FROM v)"], "SELECT id, CAST(pos AS BIGINT) AS pos, round((x - avg(x) OVER w) / CASE WHEN stddev_pop(x) OVER w = 0 THEN 1 ELSE stddev_pop(x) OVER w END, 6) + 0.0 AS x FROM e WINDOW w AS (PARTITION BY pos)")
PAIRS = joined([V], """SELECT a.id, round(list_inner_product(a.vec, b.vec), 6) AS dot, round(list_distance(a.vec, b.vec) ** 2, 6) AS l2, round(list_inner_product(a.vec, a.vec), 6) AS norm,
  round(list_sum(a.vec) + list_sum(b.vec), 6) AS added, round(list_sum(a.vec) - list_sum(b.vec), 6) AS subtracted, round((list_sum(a.vec) + list_sum(b.vec)) / 2, 6) AS middle,
  round(list_sum(list_transform(a.vec, lambda x: CAST(CAST(2 * x AS FLOAT) AS DOUBLE))), 6) AS narrowed FROM v a JOIN v b ON b.id = a.id + 1""")


def coordinates(inner: str, x: str = "x") -> str:
    return f"SELECT cluster, CAST(pos AS BIGINT) AS pos, {x} AS x FROM ({inner})"


def centroids(inner: str) -> str:
    return joined([V, HALF, SOURCES["v"], *lloyd()], coordinates(inner))


def spherical() -> str:
    return joined([V, HALF, SOURCES["v"], *lloyd("ip", unit=True)], coordinates("SELECT cluster, unnest(centroid) AS x, generate_subscripts(centroid, 1) - 1 AS pos FROM c3", "round(x, 9) + 0.0"))


def _exponential(id_: str, salt: str, rate: str) -> str:
    return f"-ln((CAST(CAST('0x' || substr(md5({id_} || ':42:{salt}'), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0) / ({rate})"


def seeded(spherical_rounds: int, rounds: int = 3, over: int = 2) -> str:
    """Candidates of each round, their weights, and K of them one after the other; then rounds of spherical k-means."""
    ctes = [V, HALF, SOURCES["v"], f"k0 AS MATERIALIZED (SELECT id, vec FROM v ORDER BY {_exponential('id', '0', '1')} DESC, id LIMIT 1)"]
    for i in range(rounds):
        ctes += [
            f"f{i} AS MATERIALIZED (SELECT v.id, any_value(v.vec) AS vec, min(list_distance(v.vec, k.vec) ** 2) AS d FROM v, k{i} k GROUP BY v.id)",
            f"k{i + 1} AS MATERIALIZED (SELECT * FROM k{i} UNION ALL SELECT * FROM (SELECT id, vec FROM f{i} WHERE d > 0 ORDER BY {_exponential('id', str(i + 1), 'd')}, id LIMIT {over * K}))",
        ]
    ctes += [
        f"own AS (SELECT v.id, min(struct_pack(d := list_distance(v.vec, k.vec) ** 2, c := k.id)) AS n FROM v, k{rounds} k GROUP BY v.id)",
        f"w AS MATERIALIZED (SELECT k.id, k.vec, w.n FROM k{rounds} k JOIN (SELECT n.c AS id, count(*) AS n FROM own GROUP BY ALL) w USING (id))",
        f"p0 AS MATERIALIZED (SELECT 0 AS step, id, vec FROM w ORDER BY {_exponential('id', 'seed0', 'n')}, id LIMIT 1)",
    ]
    for i in range(1, K):
        ctes += [
            f"g{i} AS MATERIALIZED (SELECT w.id, any_value(w.vec) AS vec, any_value(w.n) AS n, min(list_distance(w.vec, p.vec) ** 2) AS d FROM w, p{i - 1} p GROUP BY w.id)",
            f"p{i} AS MATERIALIZED (SELECT * FROM p{i - 1} UNION ALL SELECT * FROM (SELECT {i} AS step, id, vec FROM g{i} WHERE d > 0 ORDER BY {_exponential('id', f'seed{i}', 'n * d')}, id LIMIT 1))",
        ]
    ctes.append(f"c0 AS (SELECT CAST(step AS BIGINT) AS cluster, vec AS centroid FROM p{K - 1})")
    for i in range(spherical_rounds):
        ctes += [near(f"a{i}", "src", f"c{i}", "ip"), means(f"c{i + 1}", f"a{i}", f"c{i}", unit=True)]
    return joined(ctes, coordinates(f"SELECT cluster, unnest(centroid) AS x, generate_subscripts(centroid, 1) - 1 AS pos FROM c{spherical_rounds}", "round(x, 9) + 0.0"))


def assign(metric: str) -> str:
    return index("SELECT id, cluster, round(d, 6) + 0.0 AS distance FROM post", metric=metric)


ENTRY = index("SELECT c3.cluster, coalesce(n, 0) AS n, round(coalesce(s, 0.0), 6) AS s, round(coalesce(list_sum(a), 0.0), 6) AS a_total FROM c3 LEFT JOIN stat USING (cluster)", stats=True)


def probe(metric: str, cents: str = "c3") -> str:
    d = DIST[metric].format("q.vec", "c.centroid")
    return f"probe AS MATERIALIZED (SELECT q.id AS qid, q.vec AS qvec, c.cluster, {d} AS d, row_number() OVER (PARTITION BY q.id ORDER BY {d}, c.cluster) AS rank FROM v q, {cents} c WHERE q.id % 50 = 0)"


def scored(metric: str) -> str:
    return f"scored AS MATERIALIZED (SELECT qid, probe.rank AS probe, id, {DIST[metric].format('qvec', 'vec')} AS d FROM probe JOIN post USING (cluster))"


def probed(body: str, metric: str) -> str:
    return joined([*base(metric=metric), probe(metric), scored(metric)], body)


def ivf(metric: str) -> str:
    return probed("SELECT qid, rank, id, round(d, 6) + 0.0 AS distance FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rank FROM scored WHERE probe <= 4) WHERE rank <= 10", metric)


TRUTH = "truth AS MATERIALIZED (SELECT qid, id FROM (SELECT q.id AS qid, t.id, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.vec, t.vec), t.id) AS rank FROM v q, v t WHERE q.id % 50 = 0) WHERE rank <= 10)"
_SWEEP = "found AS (SELECT nprobe, qid, id FROM (SELECT nprobe, qid, id, row_number() OVER (PARTITION BY nprobe, qid ORDER BY d, id) AS rank FROM scored, (SELECT unnest({0}) AS nprobe) WHERE probe <= nprobe) WHERE rank <= 10), per AS (SELECT p.nprobe, q.qid, (SELECT count(*) FROM found f JOIN truth t ON t.qid = f.qid AND t.id = f.id WHERE f.qid = q.qid AND f.nprobe = p.nprobe) / 10.0 AS recall FROM (SELECT DISTINCT qid FROM truth) q, (SELECT unnest({0}) AS nprobe) p)"
RECALL = joined([*base(), probe("l2"), scored("l2"), TRUTH, _SWEEP.format("[4]")], "SELECT qid, CAST(round(recall, 6) AS DOUBLE) AS recall FROM per")
FRONTIER = joined([*base(), probe("l2"), scored("l2"), TRUTH, _SWEEP.format("[1, 2, 4, 8, 16]")], "SELECT CAST(nprobe AS BIGINT) AS nprobe, round(avg(CAST(recall AS DOUBLE)), 6) AS recall FROM per GROUP BY nprobe")
VIOLATIONS = joined([*base(), means("c4", "post", "c3"), near("again", "post", "c4")], "SELECT count(*) AS checked, count(*) FILTER (WHERE again.cluster <> post.cluster) AS violations, round(count(*) FILTER (WHERE again.cluster <> post.cluster) / CAST(count(*) AS DOUBLE), 6) AS violation_rate FROM again JOIN post USING (id)")
SUMMARY = joined(
    [*base(), means("c4", "post", "c3"), near("again", "post", "c4")],
    "SELECT count(*) AS partitions, CAST(sum(n) AS BIGINT) AS vectors, min(n) AS smallest, max(n) AS largest, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std, (SELECT round(count(*) FILTER (WHERE again.cluster <> post.cluster) / CAST(count(*) AS DOUBLE), 6) FROM again JOIN post USING (id)) AS violation_rate FROM (SELECT cluster, count(*) AS n FROM post GROUP BY cluster)",
)
SAMPLES = index("""SELECT cluster, id, CAST(row_number() OVER (PARTITION BY cluster ORDER BY md5(id || ':side:42'), id) > least(n, 24) // 2 AS INTEGER) AS side FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY md5(id || ':member:42'), id) AS r FROM (SELECT *, count(*) OVER (PARTITION BY cluster) AS n FROM post) WHERE n >= 12) WHERE r <= 24""")
QUOTA = joined([V], "SELECT id, source FROM (SELECT id, CAST((id + 2) % 3 AS BIGINT) AS source, row_number() OVER (ORDER BY (id + 2) % 3, id) AS r FROM v) WHERE r <= (SELECT count(*) // 2 FROM v)")
_SELF = "pairs AS (SELECT a.cluster, b.cluster AS neighbour, list_distance(a.centroid, b.centroid) ** 2 AS d, row_number() OVER (PARTITION BY a.cluster ORDER BY list_distance(a.centroid, b.centroid), b.cluster) AS rank FROM {0} a JOIN {0} b ON a.cluster <> b.cluster)"
NEIGHBOURS = joined([*base(), _SELF.format("c3")], "SELECT cluster, rank, neighbour, round(d, 6) AS distance FROM pairs WHERE rank <= 5")
MERGE = joined([*base(), STAT, _SELF.format("c3")], f"SELECT cluster, n, neighbour AS target FROM stat JOIN pairs USING (cluster) WHERE rank = 1 AND n < 0.75 * (SELECT count(*) FROM v) / (SELECT count(*) FROM c3)")

_GAIN = "CASE WHEN own = {0} THEN CASE WHEN n{0} <= 1 THEN 0 ELSE s{0} / n{0} - (s{0} - 2 * x{0} + rho) / (n{0} - 1) END WHEN n{0} = 0 THEN -1e300 ELSE (s{0} + 2 * x{0} + rho) / (n{0} + 1) - s{0} / n{0} END AS g{0}"
_STEP = "CASE WHEN go AND own = {0} THEN n{0} - 1 WHEN go THEN n{0} + 1 ELSE n{0} END, CASE WHEN go THEN list_transform(list_zip(a{0}, vec), lambda z: z[1] + z[2] * CASE WHEN own = {0} THEN -1 ELSE 1 END) ELSE a{0} END"
_SUM = "SELECT cluster, list(x ORDER BY i) AS a{0} FROM (SELECT cluster, i, sum(x) AS x FROM (SELECT cluster, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM m WHERE (pos >= n // 2) = ({0} = 1)) GROUP BY cluster, i) GROUP BY cluster"
CDKM = joined(
    [
        *base(),
        "m AS MATERIALIZED (SELECT * FROM (SELECT id, vec, cluster, pos, count(*) OVER (PARTITION BY cluster) AS n FROM post) WHERE n >= 4)",
        f"""r AS (
  SELECT cluster, 0 AS step, n, CAST(n // 2 AS BIGINT) AS n0, a0, CAST(n - n // 2 AS BIGINT) AS n1, a1, list_transform(range(n), lambda i: CAST(i >= n // 2 AS INTEGER)) AS labels
  FROM (SELECT DISTINCT cluster, n FROM m) JOIN ({_SUM.format(0)}) USING (cluster) JOIN ({_SUM.format(1)}) USING (cluster)
  UNION ALL
  SELECT cluster, step + 1, n, {_STEP.format(0)}, {_STEP.format(1)}, CASE WHEN go THEN list_transform(labels, lambda y, i: CASE WHEN i - 1 = step % n THEN 1 - own ELSE y END) ELSE labels END
  FROM (SELECT *, (g1 > g0) <> (own = 1) AS go FROM (SELECT *, {_GAIN.format(0)}, {_GAIN.format(1)} FROM (
    SELECT r.*, m.vec, labels[step % r.n + 1] AS own, list_inner_product(a0, a0) AS s0, list_inner_product(a1, a1) AS s1, list_inner_product(a0, m.vec) AS x0, list_inner_product(a1, m.vec) AS x1, list_inner_product(m.vec, m.vec) AS rho
    FROM r JOIN m ON m.cluster = r.cluster AND m.pos = step % r.n WHERE step < 5 * r.n))))""",
    ],
    "SELECT m.id, m.cluster, CAST(labels[pos + 1] AS INTEGER) AS side FROM m JOIN r ON r.cluster = m.cluster AND r.step = 5 * r.n",
    recursive=True,
)



def two_means(rounds: int) -> list[str]:
    """h{rounds}: id, vec, cluster and the side after so many rounds from the halves, of partitions of four members or more."""
    out = ["h0 AS MATERIALIZED (SELECT id, vec, cluster, CAST(pos >= n // 2 AS INTEGER) AS side FROM (SELECT *, count(*) OVER (PARTITION BY cluster) AS n FROM post) WHERE n >= 4)"]
    for i in range(rounds):
        out += [
            f"m{i} AS MATERIALIZED (SELECT cluster, side, list(x ORDER BY i) AS m FROM (SELECT cluster, side, i, avg(x) AS x FROM (SELECT cluster, side, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM h{i}) GROUP BY ALL) GROUP BY ALL)",
            f"h{i + 1} AS MATERIALIZED (SELECT x.id, x.vec, x.cluster, CAST(list_distance(x.vec, b.m) < list_distance(x.vec, a.m) AS INTEGER) AS side FROM h{i} x JOIN m{i} a ON a.cluster = x.cluster AND a.side = 0 JOIN m{i} b ON b.cluster = x.cluster AND b.side = 1)",
        ]
    return out


def lire(body: str, rounds: int = 10) -> str:
    return joined([*base(), *two_means(rounds), f"halved AS (SELECT id, side FROM h{rounds})", *_LIRE], body)


_LIRE = [
    "big AS (SELECT cluster AS j, n FROM (SELECT cluster, count(*) AS n FROM post GROUP BY cluster) ORDER BY n DESC, cluster LIMIT 1)",
    "cut AS MATERIALIZED (SELECT id, vec, CASE WHEN cluster = j AND side = 1 THEN (SELECT max(cluster) + 1 FROM c3) ELSE cluster END AS cluster FROM post LEFT JOIN halved USING (id), big)",
    "c3n AS (SELECT * FROM c3 UNION ALL SELECT (SELECT max(cluster) + 1 FROM c3), centroid FROM c3, big WHERE cluster = j)",
    means("moved", "(SELECT cut.* FROM cut, big WHERE cluster = j OR cluster = (SELECT max(cluster) + 1 FROM c3))", "c3n"),
    "ring AS (SELECT b.cluster, row_number() OVER (ORDER BY list_distance(a.centroid, b.centroid), b.cluster) AS rank FROM moved a, moved b, big WHERE a.cluster = j AND b.cluster <> j AND b.cluster <> (SELECT max(cluster) + 1 FROM c3))",
    near("best", "cut", "moved"),
    "ranked AS (SELECT cut.id, cut.cluster, best.cluster AS nearest, coalesce(ring.rank, 0) AS rank FROM cut JOIN best USING (id) LEFT JOIN ring ON ring.cluster = cut.cluster)",
]
LLOYD_SPLIT = joined([*base(), *two_means(10)], "SELECT id, cluster, side FROM h10")
_REPAIRED = "SELECT id, CASE WHEN rank <= 5 THEN nearest ELSE cluster END AS cluster FROM ranked"
LIRE, MEM_ONLY = lire(_REPAIRED), lire(_REPAIRED, 0)
LIRE_SWEEP = lire("SELECT CAST(l AS BIGINT) AS around, count(*) FILTER (WHERE l > 0 AND rank <= l AND nearest <> cluster) AS reassigned FROM ranked, (SELECT unnest([0, 1, 2, 5, 10]) AS l) GROUP BY l")
GAINS = joined(
    [*base(), STAT, "full_stat AS (SELECT c3.cluster, coalesce(n, 0) AS n, a, coalesce(s, 0.0) AS s FROM c3 LEFT JOIN stat USING (cluster))", "two AS (SELECT v.id, v.vec, c3.cluster, row_number() OVER (PARTITION BY v.id ORDER BY list_distance(v.vec, centroid), c3.cluster) AS rank FROM v, c3)"],
    """SELECT id, round(CASE WHEN n <= 1 THEN 0 ELSE s / n - (s - 2 * xa + rho) / (n - 1) END, 6) AS stay, round((s2 + 2 * xa2 + rho) / (n2 + 1) - s2 / n2, 6) AS joined,
  round(CASE WHEN n <= 1 THEN 0 ELSE (s - 2 * xa + rho) / (n - 1) + (s2 + 2 * xa2 + rho) / (n2 + 1) - s / n - s2 / n2 END, 6) AS delta
FROM (SELECT x.id, e.n, e.s, f.n AS n2, f.s AS s2, list_inner_product(x.vec, e.a) AS xa, list_inner_product(x.vec, f.a) AS xa2, list_inner_product(x.vec, x.vec) AS rho
  FROM two x JOIN two y ON x.id = y.id AND x.rank = 1 AND y.rank = 2 JOIN full_stat e ON e.cluster = x.cluster JOIN full_stat f ON f.cluster = y.cluster)""",
)
SAMPLE = joined(
    [
        *base(),
        "mid AS (SELECT a.centroid AS a, b.centroid AS b, list_transform(list_zip(a.centroid, b.centroid), lambda z: (z[1] + z[2]) / 2) AS m FROM c3 a, c3 b WHERE a.cluster = 0 AND b.cluster = 1)",
        "ring AS (SELECT cluster FROM c3, mid WHERE cluster > 1 AND cluster IN (SELECT cluster FROM post) ORDER BY list_distance(centroid, m), cluster LIMIT 2)",
        "gaps AS (SELECT cluster, id, abs(list_distance(vec, a) ** 2 - list_distance(vec, b) ** 2) AS gap, least(list_distance(vec, a), list_distance(vec, b)) AS low FROM post JOIN ring USING (cluster), mid)",
    ],
    "SELECT cluster, rank, id, round(gap, 6) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY gap, low, id) AS rank FROM gaps) WHERE rank <= 4",
)
DEDRIFT = index("""SELECT cluster, n, CASE WHEN head <= k THEN 'largest' ELSE 'smallest' END AS part FROM (
  SELECT *, row_number() OVER (ORDER BY n DESC, cluster) AS head, count(*) OVER () AS m, CASE WHEN count(*) OVER () >= 5 THEN least(5, count(*) OVER () // 2) ELSE 0 END AS k FROM (SELECT cluster, count(*) AS n FROM post GROUP BY cluster)
) WHERE head <= k OR m + 1 - head <= k""")


def rebalanced(post: str, rounds: int = 10) -> list[str]:
    """dealt: id, cluster of the rows of ``post`` after a rebalancing of its largest and smallest partitions."""
    out = [
        f"""chosen AS MATERIALIZED (SELECT cluster, row_number() OVER (ORDER BY n DESC, cluster) - 1 AS i FROM (
  SELECT *, row_number() OVER (ORDER BY n DESC, cluster) AS head, count(*) OVER () AS m, CASE WHEN count(*) OVER () >= 5 THEN least(5, count(*) OVER () // 2) ELSE 0 END AS k FROM (SELECT cluster, count(*) AS n FROM {post} GROUP BY cluster)
) WHERE head <= k OR m + 1 - head <= k)""",
        f"pool AS MATERIALIZED (SELECT id, vec FROM {post} JOIN chosen USING (cluster))",
        "d0 AS (SELECT row_number() OVER (ORDER BY id) - 1 AS cluster, vec AS centroid FROM (SELECT * FROM pool ORDER BY id LIMIT (SELECT count(*) FROM chosen)))",
    ]
    for i in range(rounds):
        out += [near(f"e{i}", "pool", f"d{i}"), means(f"d{i + 1}", f"e{i}", f"d{i}")]
    return [*out, near("anew", "pool", f"d{rounds}"), f"dealt AS (SELECT id, chosen.cluster FROM anew JOIN chosen ON chosen.i = anew.cluster UNION ALL SELECT id, cluster FROM {post} WHERE cluster NOT IN (SELECT cluster FROM chosen))"]


REBALANCED = joined([*base(), *rebalanced("post")], "SELECT id, cluster FROM dealt")
REBALANCED_STREAM = joined([*base("first"), near("everyone", "v", "c3"), "live AS MATERIALIZED (SELECT id, vec, cluster FROM everyone, half WHERE id < h OR id - h >= r // 10)", *rebalanced("live")], "SELECT id, cluster FROM dealt")
MERGED = joined(
    [
        *base(),
        STAT,
        _SELF.format("c3"),
        "small AS MATERIALIZED (SELECT cluster AS c, neighbour AS t, row_number() OVER (ORDER BY cluster) AS k FROM stat JOIN pairs USING (cluster) WHERE rank = 1 AND n < 0.75 * (SELECT count(*) FROM v) / (SELECT count(*) FROM c3))",
        """m AS (
  SELECT CAST(0 AS BIGINT) AS step, CAST([] AS BIGINT[]) AS froms, CAST([] AS BIGINT[]) AS tos
  UNION ALL
  SELECT step + 1, CASE WHEN list_contains(tos, c) THEN froms ELSE list_append(froms, c) END, CASE WHEN list_contains(tos, c) THEN tos ELSE list_append(tos, coalesce(tos[list_position(froms, t)], t)) END FROM m JOIN small ON k = step + 1)""",
        "moves AS (SELECT unnest(froms) AS cluster, unnest(tos) AS target FROM (SELECT * FROM m ORDER BY step DESC LIMIT 1))",
    ],
    "SELECT id, coalesce(target, cluster) AS cluster FROM post LEFT JOIN moves USING (cluster)",
    recursive=True,
)
_INSERTED = [*base("first"), near("everyone", "v", "c3")]
UPDATED = joined([*_INSERTED, means("after", "everyone", "c3")], coordinates("SELECT cluster, unnest(centroid) AS x, generate_subscripts(centroid, 1) - 1 AS pos FROM after"))
FROZEN = joined(_INSERTED, "SELECT id, cluster FROM everyone")

_MOVED = "list_transform(range(1, len(cents) + 1), lambda i: CASE WHEN i = c THEN {1} ELSE {0}[i] END)"
_JOINED = "list_transform(list_zip(sums[c], whole), lambda z: z[1] + z[2])"
ONE_BY_ONE = joined(
    [
        *base("first"),
        STAT.replace("CAST(sum(CAST(floor(x * 1e9 + 0.5) AS BIGINT)) AS DOUBLE) / 1e9 AS x", "CAST(sum(CAST(floor(x * 1e9 + 0.5) AS BIGINT)) AS BIGINT) AS x").replace("list_inner_product(a, a) AS s", "0 AS s"),
        "s AS MATERIALIZED (SELECT id, id - h AS place, vec, list_transform(vec, lambda x: CAST(floor(x * 1e9 + 0.5) AS BIGINT)) AS whole FROM v, half WHERE id >= h)",
        "init AS (SELECT list(centroid ORDER BY cluster) AS cents, list(coalesce(n, 0) ORDER BY cluster) AS ns, list(coalesce(a, list_transform(centroid, lambda x: CAST(0 AS BIGINT))) ORDER BY cluster) AS sums FROM c3 LEFT JOIN stat USING (cluster))",
        f"""r AS (
  SELECT CAST(0 AS BIGINT) AS step, cents, ns, sums, CAST(0 AS BIGINT) AS took FROM init
  UNION ALL
  SELECT step + 1, {_MOVED.format("cents", "list_transform(" + _JOINED + ", lambda y: CAST(y AS DOUBLE) / 1e9 / (ns[c] + 1))")}, {_MOVED.format("ns", "ns[c] + 1")}, {_MOVED.format("sums", _JOINED)}, c - 1
  FROM (SELECT *, CAST(list_position(ds, list_min(ds)) AS BIGINT) AS c FROM (SELECT r.*, s.vec, s.whole, list_transform(cents, lambda z: list_distance(z, s.vec)) AS ds FROM r JOIN s ON s.place = r.step)))""",
    ],
    "SELECT id, took AS cluster FROM r JOIN s ON s.place = r.step - 1 UNION ALL SELECT id, cluster FROM post",
    recursive=True,
)

AFTER_DELETES = joined(
    [*base("first"), near("everyone", "v", "c3"), probe("l2"), "scored AS MATERIALIZED (SELECT qid, probe.rank AS probe, id, list_distance(qvec, vec) AS d FROM probe JOIN everyone USING (cluster), half WHERE id >= h // 4)", TRUTH, _SWEEP.format("[1, 4, 16]")],
    "SELECT CAST(nprobe AS BIGINT) AS nprobe, round(avg(CAST(recall AS DOUBLE)), 6) AS recall FROM per GROUP BY nprobe",
)


def policy(moved: bool) -> str:
    return joined([*base("first"), near("everyone", "v", "c3")], "SELECT id, cluster FROM everyone, half WHERE id < h OR id - h >= r // 10")


LOG = joined([V, HALF, "rest AS (SELECT id, id - h AS place, r FROM v, half WHERE id >= h)"], """SELECT CAST(place + place // 10 AS BIGINT) AS seq, CAST(place // 50 AS BIGINT) AS batch, 'insert' AS op, id FROM rest
UNION ALL SELECT CAST(due + 1 + place AS BIGINT), CAST(due // 50 AS BIGINT), 'delete', id FROM (SELECT *, (place + 1) * 10 - 1 AS due FROM rest) WHERE due < r""")
LIVE = joined([V, HALF, SOURCES["live"]], "SELECT id FROM src")
def _asked_by_turn(turn: str, turns: str) -> list[str]:
    """ask, alive, found and truth of the queries in each round: ``turn`` names a query's round, ``turns`` gives rounds and the inserts before each ends."""
    return [
        *_INSERTED,
        f"asked AS (SELECT id AS qid, vec, {turn} AS turn FROM v WHERE id % 50 = 0)",
        f"turns AS ({turns})",
        "ask AS MATERIALIZED (SELECT round, n, qid, vec FROM asked, turns WHERE turn = round)",
        "alive AS MATERIALIZED (SELECT round, e.id, e.vec, e.cluster FROM everyone e, turns t, half WHERE e.id < h OR (e.id - h < t.n AND e.id - h >= t.n // 10))",
        "probe AS (SELECT round, qid, vec, cluster FROM (SELECT round, qid, a.vec, c3.cluster, row_number() OVER (PARTITION BY round, qid ORDER BY list_distance(a.vec, centroid), c3.cluster) AS k FROM ask a, c3) WHERE k <= 8)",
        "found AS (SELECT round, qid, id FROM (SELECT p.round, p.qid, e.id, row_number() OVER (PARTITION BY p.round, p.qid ORDER BY list_distance(p.vec, e.vec), e.id) AS k FROM probe p JOIN alive e ON e.round = p.round AND e.cluster = p.cluster) WHERE k <= 10)",
        "truth AS (SELECT round, qid, id FROM (SELECT a.round, a.qid, e.id, row_number() OVER (PARTITION BY a.round, a.qid ORDER BY list_distance(a.vec, e.vec), e.id) AS k FROM ask a JOIN alive e ON e.round = a.round) WHERE k <= 10)",
        "each AS (SELECT CAST(ask.round AS BIGINT) AS round, ask.qid, CAST(coalesce(hits, 0) AS DOUBLE) / 10 AS recall FROM ask LEFT JOIN (SELECT round, qid, count(*) AS hits FROM found JOIN truth USING (round, qid, id) GROUP BY round, qid) g ON g.round = ask.round AND g.qid = ask.qid)",
    ]


MIXED = joined(_asked_by_turn("(id // 50) % 5 + 1", "SELECT r AS round, (SELECT r FROM half) * r // 5 AS n FROM (SELECT unnest(range(1, 6)) AS r)"), "SELECT round, qid, round(recall, 6) AS recall FROM each")
_ANGLE = "acos(greatest(least({0}, 1 - 1e-8), -1 + 1e-8))"
OBSERVED = joined(
    [
        *_asked_by_turn("(id // 50) % 10", "SELECT b AS round, least((SELECT r FROM half), (b + 1) * size) AS n, least((SELECT r FROM half), b * size) AS n0 FROM (SELECT unnest(range(10)) AS b), (SELECT (r + 9) // 10 AS size FROM half)"),
        "sims AS (SELECT round, qid, list_inner_product(a.vec, centroid) AS sim, row_number() OVER (PARTITION BY round, qid ORDER BY -list_inner_product(a.vec, centroid), c3.cluster) AS k FROM ask a, c3)",
        f"edge AS (SELECT x.round, avg({_ANGLE.format('x.sim')} / ({_ANGLE.format('y.sim')} + 1e-8)) AS boundary FROM sims x JOIN sims y ON x.round = y.round AND x.qid = y.qid AND x.k = 1 AND y.k = 2 GROUP BY x.round)",
        "means AS (SELECT round, count(*) AS queries, avg(recall) AS recall FROM each GROUP BY round)",
    ],
    "SELECT CAST(t.round AS BIGINT) AS batch, CAST(n - n0 AS BIGINT) AS inserts, CAST(n // 10 - n0 // 10 AS BIGINT) AS deletes, coalesce(queries, 0) AS queries, CAST(h + n - n // 10 AS BIGINT) AS vectors, round(recall, 6) AS recall, round(boundary, 6) AS boundary FROM turns t CROSS JOIN half LEFT JOIN means m ON m.round = t.round LEFT JOIN edge e ON e.round = t.round",
)
NPY = joined([V], "SELECT id, CAST(generate_subscripts(vec, 1) - 1 AS BIGINT) AS pos, CAST(CAST(unnest(vec) AS FLOAT) AS DOUBLE) AS x FROM v")
DATASET = joined([V, "size AS (SELECT count(*) AS n FROM v)"], "SELECT qid, rank, id FROM (SELECT q.id - (n - n // 10) AS qid, t.id, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.vec, t.vec), t.id) AS rank FROM v q, v t, size WHERE q.id >= n - n // 10 AND t.id < n - n // 10) WHERE rank <= 5")


def scores(body: str) -> str:
    angle = lambda x: f"acos(greatest(least({x}, 1 - 1e-8), -1 + 1e-8))"
    return joined(
        [
            V,
            HALF,
            SOURCES["v"],
            *lloyd(),
            "two AS (SELECT v.id AS qid, list_inner_product(v.vec, centroid) AS sim, row_number() OVER (PARTITION BY v.id ORDER BY -list_inner_product(v.vec, centroid), c3.cluster) AS rank FROM v, c3)",
            f"score AS (SELECT x.qid, {angle('x.sim')} / ({angle('y.sim')} + 1e-8) AS score FROM two x JOIN two y ON x.qid = y.qid AND x.rank = 1 AND y.rank = 2)",
        ],
        body,
    )


BOUNDARY_RECALL = joined(
    [
        *base(),
        "two AS (SELECT v.id AS qid, list_inner_product(v.vec, centroid) AS sim, row_number() OVER (PARTITION BY v.id ORDER BY -list_inner_product(v.vec, centroid), c3.cluster) AS rank FROM v, c3)",
        "score AS (SELECT x.qid, acos(greatest(least(x.sim, 1 - 1e-8), -1 + 1e-8)) / (acos(greatest(least(y.sim, 1 - 1e-8), -1 + 1e-8)) + 1e-8) AS score FROM two x JOIN two y ON x.qid = y.qid AND x.rank = 1 AND y.rank = 2)",
        "q AS MATERIALIZED (SELECT kind, id AS qid, vec FROM v JOIN (SELECT 'boundary' AS kind, qid FROM (SELECT qid FROM score ORDER BY score.score DESC, qid LIMIT 20) UNION ALL SELECT 'asked', id FROM v WHERE id % 50 = 0) s ON s.qid = v.id)",
        "pr AS (SELECT * FROM (SELECT kind, qid, q.vec, c3.cluster, row_number() OVER (PARTITION BY kind, qid ORDER BY list_distance(q.vec, centroid), c3.cluster) AS k FROM q, c3) WHERE k <= 2)",
        "found AS (SELECT kind, qid, id FROM (SELECT kind, qid, post.id, row_number() OVER (PARTITION BY kind, qid ORDER BY list_distance(pr.vec, post.vec), post.id) AS k FROM pr JOIN post USING (cluster)) WHERE k <= 10)",
        "truth AS (SELECT kind, qid, id FROM (SELECT kind, qid, v.id, row_number() OVER (PARTITION BY kind, qid ORDER BY list_distance(q.vec, v.vec), v.id) AS k FROM q, v) WHERE k <= 10)",
        "hits AS (SELECT kind, qid, count(*) AS hits FROM found JOIN truth USING (kind, qid, id) GROUP BY kind, qid)",
    ],
    "SELECT q.kind, count(*) AS n, round(avg(CAST(coalesce(hits, 0) AS DOUBLE) / 10), 6) AS recall FROM q LEFT JOIN hits ON hits.kind = q.kind AND hits.qid = q.qid GROUP BY q.kind",
)
_SIDES = """SELECT side, count(*) AS n, round(avg(recall), 6) AS recall, round(quantile_cont(latency, 0.5), 6) AS p50, round(quantile_cont(latency, 0.99), 6) AS p99
FROM (SELECT CASE WHEN score >= {} THEN 'boundary' ELSE 'interior' END AS side, CAST((qid % 11) / 10.0 AS DOUBLE) AS recall, CAST(qid * 37 % 101 AS DOUBLE) AS latency FROM score) GROUP BY side"""
BOUNDARY_SPLIT, BOUNDARY_SPLIT_AT = scores(_SIDES.format("(SELECT quantile_cont(score, 0.75) FROM score)")), scores(_SIDES.format("0.97"))

RESULTS = "r AS (SELECT event_id AS seq, event_type AS method, user_id % 5 AS dataset, user_id % 3 AS seed, value FROM events)"


def reports(body: str, *more: str) -> str:
    return joined([RESULTS, *more], body)


LATENCIES = reports("SELECT method, count(*) AS n, round(avg(value), 9) AS mean, round(stddev_pop(value), 9) AS std, " + ", ".join(f"round(quantile_cont(value, {q}), 9) AS {n}" for q, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"), (0.999, "p999"))) + " FROM r WHERE isfinite(value) GROUP BY method")

STREAM = reports("SELECT method, count(*) FILTER (WHERE batch >= 10) AS timed, round(avg(recall) FILTER (WHERE batch % 7 > 0), 9) AS recall, round(avg(CAST(batch % 7 AS DOUBLE)) FILTER (WHERE batch % 7 > 0), 9) AS qps, " + ", ".join(f"round(quantile_cont(latency, {q}) FILTER (WHERE batch >= 10), 9) AS {n}" for q, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"), (0.999, "p999"))) + " FROM b GROUP BY method", "b AS (SELECT method, seq // 100 AS batch, avg(value) AS recall, max(value) AS latency FROM r GROUP BY ALL)")


def traces(body: str) -> str:
    return reports(body, "parts AS (SELECT method, dataset, value, ntile(12) OVER (PARTITION BY method, dataset ORDER BY seq) AS part FROM r)", "trace AS (SELECT method, dataset, part, avg(value) AS mean, quantile_cont(value, 0.99) AS p99 FROM parts GROUP BY ALL)")


TRACE_ENVELOPE = traces("SELECT method, part, round(avg(mean), 9) AS mean, round(min(mean), 9) AS low, round(max(mean), 9) AS high FROM trace JOIN (SELECT method, min(z) AS z FROM (SELECT method, dataset, max(part) AS z FROM trace GROUP BY ALL) GROUP BY method) USING (method) WHERE part <= z GROUP BY method, part")
CDF = reports("SELECT seq, method, value, round(row_number() OVER (PARTITION BY method ORDER BY value NULLS FIRST, seq) / CAST(count(*) OVER (PARTITION BY method) AS DOUBLE), 9) AS share FROM r")
ENVELOPE = reports("SELECT method, seed, round(avg(value), 9) AS mean, round(min(value), 9) AS low, round(max(value), 9) AS high FROM (SELECT method, seed, dataset, avg(value) AS value FROM r GROUP BY ALL) GROUP BY method, seed")
SEEDS = reports("SELECT method, count(*) AS seeds, round(avg(recall), 9) AS recall_mean, round(stddev_pop(recall), 9) AS recall_std, round(avg(qps), 9) AS qps_mean, round(stddev_pop(qps), 9) AS qps_std FROM (SELECT method, seed, avg(value) AS recall, CAST(count(*) AS DOUBLE) AS qps FROM r GROUP BY ALL) GROUP BY method")
BUDGETS = reports("SELECT round(b.budget, 9) AS budget, method, round(recall, 9) AS recall, qps FROM b LEFT JOIN (SELECT budget, method, recall, qps, row_number() OVER (PARTITION BY budget ORDER BY recall DESC, qps DESC, method) AS k FROM b JOIN c ON cost <= budget) s ON s.budget = b.budget AND k = 1", "c AS (SELECT method, avg(value) AS cost, quantile_cont(value, 0.9) AS recall, CAST(count(*) AS DOUBLE) AS qps FROM r GROUP BY method)", "b AS (SELECT -1.0 AS budget UNION ALL SELECT 1e9 UNION ALL SELECT avg(cost) FROM c)")
SPEEDUP = reports("SELECT count(*) AS datasets, round(avg(y.value / x.value), 9) AS mean, round(min(y.value / x.value), 9) AS low, round(max(y.value / x.value), 9) AS high FROM e x JOIN e y USING (dataset) WHERE x.method = 'click' AND y.method = 'view' AND x.value <> 0", "e AS (SELECT method, dataset, avg(value) AS value FROM r GROUP BY ALL)")
LOOKUP = reports("SELECT method, round(arg_min(value, struct_pack(g := abs(dataset - 2.4), d := dataset)), 9) AS nearest, round(max(value) FILTER (WHERE dataset = 3), 9) AS at_3, round(max(value) FILTER (WHERE dataset = 9), 9) AS at_9 FROM e GROUP BY method", "e AS (SELECT method, dataset, avg(value) AS value FROM r GROUP BY ALL)")
FLAT = reports("SELECT method, CAST(seq // 100 AS BIGINT) AS batch, row_number() OVER (PARTITION BY method, seq // 100 ORDER BY seq) - 1 AS place, seq, value FROM r")
KEYS = reports("SELECT label, lower(regexp_replace(label, '[ _-]', '', 'g')) AS key, CAST(regexp_extract(label, 'L(\\d+)$', 1) AS BIGINT) AS size, replace(label, 'My-', 'Our ') AS shown, printf('%.3f', n / 8.0) AS text FROM (SELECT 'My-' || upper(method[1]) || lower(method[2:]) || '_L' || dataset AS label, count(*) AS n FROM r GROUP BY method, dataset)")
LAST = reports("SELECT method, count(*) FILTER (WHERE dataset = 1 OR method NOT IN ('click', 'view')) AS n FROM r GROUP BY method")


def _claims() -> str:
    from .plans.reports import CLAIMS as sections

    parts = []
    for name, (columns, ratios, measures) in sections.items():
        picked = ", ".join(f"max(value) FILTER (WHERE method = '{m}' AND metric = '{k}') AS {c}" for c, (m, k) in columns.items())
        also = "".join(f", CASE WHEN {b} <> 0 THEN {a} / {b} END AS {c}" for c, (a, b) in ratios.items())
        rows = f"(SELECT *{also} FROM (SELECT dataset, {picked} FROM named {'WHERE dataset >= 2' if name == 'drift' else ''} GROUP BY dataset))"
        parts += [f"SELECT '{name}' AS section, '{s}_{c}' AS name, round(CAST({'avg' if s == 'mean' else s}({c}) AS DOUBLE), 9) AS value FROM {rows}" for s, c in measures]
    return " UNION ALL ".join(parts)


_NAMED = [
    "g AS (SELECT dataset, CASE method WHEN 'click' THEN 'lire' WHEN 'view' THEN 'scdkm' WHEN 'signup' THEN 'frozen' WHEN 'error' THEN 'lire_l0' ELSE 'lire_l5' END AS method, avg(value) AS mean, max(value) AS high, CAST(count(*) AS DOUBLE) AS n, min(value) AS low FROM r GROUP BY ALL)",
    "named AS (SELECT dataset, method, unnest(['maintenance', 'qps', 'violations', 'p99', 'delete_p99', 'query_p99', 'reassigned', 'recall']) AS metric, unnest([mean, mean, mean, high, high, high, n, low]) AS value FROM g)",
]
CLAIMS = reports(_claims(), *_NAMED)
BASELINES = reports("SELECT dataset, CASE method WHEN 'lire_l0' THEN 'LIRE-0' ELSE 'LIRE-5' END AS method, round(n, 9) AS reassigned, round(mean, 9) AS maintenance FROM g WHERE method IN ('lire_l0', 'lire_l5') AND NOT (dataset = 1 AND method = 'lire_l0')", _NAMED[0])
_TAKEN = "list_transform(lists, lambda l, i: CASE WHEN i = k AND op = 'insert' THEN list_append(l, oid) WHEN i = k THEN list_transform(l[1 : len(l) - 1], lambda y: CASE WHEN y = oid THEN l[len(l)] ELSE y END) ELSE l END)"
POSITIONS = joined(
    [
        *_INSERTED,
        "own AS (SELECT c3.cluster, coalesce(l, CAST([] AS BIGINT[])) AS l FROM c3 LEFT JOIN (SELECT cluster, list(id ORDER BY id) AS l FROM post GROUP BY cluster) p USING (cluster))",
        "rest AS (SELECT id, id - h AS place, r FROM v, half WHERE id >= h)",
        """log AS MATERIALIZED (SELECT seq, op, id AS oid, cluster + 1 AS k FROM (SELECT place + place // 10 AS seq, 'insert' AS op, id FROM rest
  UNION ALL SELECT due + 1 + place, 'delete', id FROM (SELECT *, (place + 1) * 10 - 1 AS due FROM rest) WHERE due < r) JOIN (SELECT id, cluster FROM everyone) USING (id))""",
        f"walk AS (SELECT CAST(0 AS BIGINT) AS step, list(l ORDER BY cluster) AS lists FROM own UNION ALL SELECT step + 1, {_TAKEN} FROM walk JOIN log ON seq = step)",
        "done AS (SELECT lists FROM walk ORDER BY step DESC LIMIT 1)",
        "flat AS (SELECT unnest(lists) AS l, generate_subscripts(lists, 1) - 1 AS cluster FROM done)",
    ],
    "SELECT unnest(l) AS id, CAST(cluster AS BIGINT) AS cluster, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS pos FROM flat",
    recursive=True,
)
