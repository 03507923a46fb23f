"""DuckDB SQL that answers each registered query from the same tables."""

from __future__ import annotations

# --- shared fragments -------------------------------------------------------

DATASET = (
    "CASE label % 3 WHEN 0 THEN 'SeaTurtleID2022' WHEN 1 THEN 'SalamanderID2025' "
    "ELSE 'LynxID2025' END"
)

IMAGES = f"""
images AS (
  SELECT vec_id AS image_id, {DATASET} AS dataset, label, embedding AS v,
         CASE WHEN vec_id % 10 <> 0
              THEN {DATASET} || '_' || label || '_' || (vec_id % 7) END AS identity
  FROM embeddings),
known AS (SELECT * FROM images WHERE identity IS NOT NULL),
unknown AS (SELECT * FROM images WHERE identity IS NULL)"""

ELIGIBLE = f"""{IMAGES},
counted AS (
  SELECT image_id, identity, dataset,
         count(image_id) OVER (PARTITION BY identity) AS identity_count FROM images),
eligible AS (SELECT * FROM counted WHERE identity IS NOT NULL AND identity_count > 2)"""


def assigned(train: float = 0.6, val: float = 0.5) -> str:
    return f"""{ELIGIBLE},
ids AS (
  SELECT identity, row_number() OVER (ORDER BY md5('42|' || identity), identity) AS r,
         count(*) OVER () AS n
  FROM (SELECT DISTINCT identity FROM eligible)),
held AS (
  SELECT identity, row_number() OVER (ORDER BY md5('43|' || identity), identity) AS r,
         count(*) OVER () AS m
  FROM ids WHERE r > floor({train}::DOUBLE * n)),
assigned AS (
  SELECT identity, 'train' AS p FROM ids WHERE r <= floor({train}::DOUBLE * n)
  UNION ALL
  SELECT identity, CASE WHEN r <= floor({val}::DOUBLE * m) THEN 'val' ELSE 'test' END FROM held)"""


ASSIGNED = assigned()


def parts(identities: str, gallery: str, single: str) -> str:
    return f"""{identities},
ranked AS (
  SELECT e.*, a.p,
         row_number() OVER (PARTITION BY identity ORDER BY md5('44|' || image_id), image_id) AS r,
         count(*) OVER (PARTITION BY identity) AS n
  FROM eligible e JOIN assigned a USING (identity)),
sized AS (SELECT *, {gallery} AS g FROM ranked),
parts AS (
  SELECT image_id, identity, dataset,
         CASE WHEN p <> 'train' THEN p
              WHEN n = 1 THEN '{single}'
              WHEN r <= g THEN 'train'
              WHEN n - g = 1 THEN 'val'
              WHEN r > n - ceil((n - g) / 2.0::DOUBLE) THEN 'test'
              ELSE 'val' END AS part
  FROM sized)"""


PARTS = parts(ASSIGNED, "floor(0.8::DOUBLE * n)", "train")
SQUARED = (
    "list_sum(list_transform(list_zip({a}, {b}), "
    "lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"
)
PAIRED = (
    "sqrt(list_sum(list_transform(list_zip({a}, {b}), "
    "lambda z: (z[1]::DOUBLE - z[2]::DOUBLE + 1e-6) * (z[1]::DOUBLE - z[2]::DOUBLE + 1e-6))))"
)
PLAIN = f"sqrt({SQUARED})"

PART_ROWS = f"""{PARTS},
part_rows AS (SELECT p.*, i.v FROM parts p JOIN images i USING (image_id)),
train AS (SELECT * FROM part_rows WHERE part = 'train'),
val AS (SELECT * FROM part_rows WHERE part = 'val'),
test AS (SELECT * FROM part_rows WHERE part = 'test'),
train_val AS (SELECT * FROM part_rows WHERE part IN ('train', 'val'))"""


def nearest(name: str, queries: str, gallery: str, k: int, other: bool = False, label: str = "identity") -> str:
    """CTE with the k nearest gallery rows of each query row."""
    where = f"WHERE q.{label} <> g.{label}" if other else ""
    return f"""
{name} AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY distance, neighbor_id) AS rank
    FROM (SELECT q.image_id, q.{label} AS {label}, g.image_id AS neighbor_id,
                 g.{label} AS neighbor_{label}, {SQUARED.format(a='q.v', b='g.v')} AS distance
          FROM {queries} q, {gallery} g {where}))
  WHERE rank <= {k})"""


def null_stats(name: str, gallery: str, ks: tuple[int, ...]) -> str:
    """CTEs <name>_d (row medians per k) and <name>_s (median and mad per k)."""
    values = ", ".join(f"({k})" for k in ks)
    return f"""{nearest(name, gallery, gallery, max(ks), other=True)},
{name}_d AS (
  SELECT image_id, k AS num_neighbors, median(distance) AS distance
  FROM {name}, (VALUES {values}) t(k) WHERE rank <= k GROUP BY image_id, k),
{name}_m AS (SELECT num_neighbors, median(distance) AS median FROM {name}_d GROUP BY 1),
{name}_s AS (
  SELECT num_neighbors, any_value(median) AS median, median(abs(distance - median)) AS mad
  FROM {name}_d JOIN {name}_m USING (num_neighbors) GROUP BY 1)"""


def grid(low: float, high: float, n: int) -> str:
    return f"""
grid AS (
  SELECT CASE WHEN i = {n - 1} THEN {high}::DOUBLE
              ELSE {low}::DOUBLE + i * (({high}::DOUBLE - {low}::DOUBLE) / {n - 1}) END AS threshold
  FROM range({n}) t(i))"""


GATE = "distance - median < threshold * mad * 1.4826::DOUBLE"


def sweep(name: str, found: str, others: str, gallery: str, stats: str, gate: str = GATE) -> str:
    """CTE with one scored row per neighbour count of ``stats`` and threshold."""
    return f"""
{name}_votes AS (
  SELECT num_neighbors, threshold, image_id, neighbor_identity, count(*) AS votes, min(rank) AS first
  FROM {found}, {stats} s, grid WHERE rank <= num_neighbors AND {gate}
  GROUP BY ALL),
{name}_won AS (
  SELECT *, row_number() OVER (
    PARTITION BY num_neighbors, threshold, image_id ORDER BY votes DESC, first) AS place
  FROM {name}_votes),
{name}_pred AS (
  SELECT s.num_neighbors, s.median, s.mad, g.threshold, o.image_id, o.identity,
         coalesce(w.neighbor_identity, 'new_individual') AS prediction,
         o.identity IN (SELECT identity FROM {gallery}) AS is_known
  FROM {others} o CROSS JOIN {stats} s CROSS JOIN grid g
  LEFT JOIN {name}_won w
    ON w.image_id = o.image_id AND w.num_neighbors = s.num_neighbors
   AND w.threshold = g.threshold AND w.place = 1),
{name}_ids AS (
  SELECT num_neighbors, median, mad, threshold, identity, is_known,
         avg((prediction = identity)::INT) AS hit, avg((prediction = 'new_individual')::INT) AS miss
  FROM {name}_pred GROUP BY ALL),
{name} AS (
  SELECT *, 1.0::DOUBLE - abs(baks - baus) AS crossover_score, sqrt(baks * baus) AS score
  FROM (SELECT num_neighbors, median, mad, threshold,
               avg(hit) FILTER (is_known) AS baks, avg(miss) FILTER (NOT is_known) AS baus
        FROM {name}_ids GROUP BY num_neighbors, median, mad, threshold))"""


SWEPT = """round(threshold, 6) AS threshold, round(baks, 6) AS baks, round(baus, 6) AS baus,
  round(crossover_score, 6) AS crossover_score, round(score, 6) AS score"""
SWEPT_ALL = SWEPT + """, num_neighbors::INT AS num_neighbors,
  round(median, 6) AS median, round(mad, 6) AS mad"""

NEIGHBORS = """image_id, rank::INT AS rank, round(distance, 6) AS distance, neighbor_id,
  neighbor_identity"""

VAL_NN1 = f"WITH {PART_ROWS},{nearest('nn', 'val', 'train', 1)}"
BY_DISTANCE = "CASE WHEN distance > 1.2 THEN 'new_individual' ELSE neighbor_identity END"

SCORED = f"""{VAL_NN1},
rows AS (
  SELECT image_id, identity, {BY_DISTANCE} AS prediction,
         identity IN (SELECT identity FROM train) AS is_known
  FROM nn),
per_id AS (
  SELECT identity, is_known, avg((prediction = identity)::INT) AS hit,
         avg((prediction = 'new_individual')::INT) AS miss FROM rows GROUP BY ALL)"""

COMPETITION = f"""{SCORED},
per_cell AS (
  SELECT dataset, r.identity, is_known, avg((prediction = r.identity)::INT) AS hit,
         avg((prediction = 'new_individual')::INT) AS miss
  FROM rows r JOIN val USING (image_id) GROUP BY ALL),
per_dataset AS (
  SELECT dataset, coalesce(avg(hit) FILTER (is_known), 0) AS baks,
         coalesce(avg(miss) FILTER (NOT is_known), 0) AS baus
  FROM per_cell GROUP BY dataset)"""

SPECIES = f"""{IMAGES},
species AS (
  SELECT image_id, identity,
         CASE label % 5 WHEN 0 THEN 'lynx' WHEN 1 THEN 'salamander'
              WHEN 2 THEN 'loggerhead turtle' WHEN 3 THEN 'fox' END AS species,
         CASE WHEN identity IS NULL THEN 'query' ELSE 'database' END AS split
  FROM images),
relabelled AS (
  SELECT image_id, CASE WHEN split = 'query' THEN species || '_query' ELSE identity END AS identity,
         CASE WHEN species IN ('lynx', 'salamander', 'loggerhead turtle') THEN species
              ELSE 'unknown' END AS species
  FROM species)"""

TOKENS = """
  SELECT vec_id AS image_id, i AS pos, embedding[i + 1]::DOUBLE AS cls,
         ((embedding[i + 17]::DOUBLE + embedding[i + 33]::DOUBLE) + embedding[i + 49]::DOUBLE) / 3 AS avg_patch
  FROM embeddings, range(16) t(i)"""

FLAWED = """
solution AS (SELECT doc_id AS image_id FROM documents),
submission AS (
  SELECT doc_id AS image_id, CASE WHEN quality = 1 THEN 'LynxID2025_1' ELSE 'Fox_1' END AS identity
  FROM labels)"""

DATABASE = f"""{IMAGES},
database AS (
  SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY identity) AS c FROM known) WHERE c >= 2)"""


def random_integer(key: str, draw: str) -> str:
    return f"('0x' || substr(md5('42|' || {key} || '|' || {draw}), 1, 15))::BIGINT"


def positives(draws: int) -> str:
    return f"""{DATABASE},
placed AS (
  SELECT image_id, identity, v, count(*) OVER (PARTITION BY identity) AS n,
         row_number() OVER (PARTITION BY identity ORDER BY md5('42|' || image_id), image_id) AS place
  FROM database),
picked AS (
  SELECT image_id, identity, draw, place,
         {random_integer('image_id', 'draw')} % (n - 1) + 1 AS pick
  FROM placed, range(1, {draws + 1}) t(draw)),
positives AS (
  SELECT a.image_id AS anchor_id, a.draw, p.image_id AS positive_id
  FROM picked a JOIN placed p
    ON p.identity = a.identity AND p.place = CASE WHEN a.pick < a.place THEN a.pick ELSE a.pick + 1 END)"""


def negatives(scope: str) -> str:
    """Rows are numbered identity by identity, in hash order of the identity."""
    by = f"PARTITION BY {scope} " if scope else ""
    on = f"AND f.{scope} = a.{scope}" if scope else ""
    columns = f"{scope}, " if scope else ""
    return f"""{DATABASE},
placed AS (
  SELECT image_id, identity, {columns}
         row_number() OVER ({by}ORDER BY md5('42|' || identity), identity, md5('42|' || image_id), image_id) AS place,
         count(*) OVER ({by}) AS total,
         count(*) OVER (PARTITION BY {columns}identity) AS n
  FROM database),
spanned AS (SELECT *, min(place) OVER (PARTITION BY {columns}identity) - 1 AS start FROM placed),
picked AS (
  SELECT *, {random_integer('image_id', 'draw')} % (total - n) + 1 AS pick
  FROM spanned, range(1, 3) t(draw))
SELECT a.image_id AS anchor_id, a.draw::INT AS draw, f.image_id AS negative_id
FROM picked a JOIN placed f
  ON f.place = CASE WHEN a.pick <= a.start THEN a.pick ELSE a.pick + a.n END {on}"""


BATCHED = """
batched AS (
  SELECT *, (row_number() OVER (ORDER BY md5('42|' || image_id), image_id) - 1) // 100 AS batch
  FROM database)"""

MINED = f"""{positives(1)},{BATCHED},
measured AS (
  SELECT anchor_id, draw, positive_id, a.v AS av, p.v AS pv, a.identity, a.batch,
         {PAIRED.format(a='a.v', b='p.v')} AS dp
  FROM positives JOIN batched a ON a.image_id = anchor_id JOIN batched p ON p.image_id = positive_id),
candidates AS (
  SELECT m.*, n.image_id AS negative_id, n.v AS nv, {PLAIN.format(a='m.av', b='n.v')} AS dn
  FROM measured m JOIN batched n ON n.batch = m.batch AND n.identity <> m.identity),
mined AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id, draw ORDER BY dn, negative_id) AS place
    FROM candidates WHERE dn > dp AND dn < dp + 0.2)
  WHERE place = 1)"""


def hinge(dims: int) -> str:
    a, p, n = (f"{c}[1:{dims}]" for c in ("av", "pv", "nv"))
    return f"greatest({PAIRED.format(a=a, b=p)} - {PAIRED.format(a=a, b=n)} + 0.2::DOUBLE, 0)"


# The 64 prefix is not shorter than the vector: only its weight counts.
NESTED = (
    f"({hinge(64)} + 0.5 * {hinge(32)} + 0.25 * {hinge(16)} + 0.125 * {hinge(2)}) / 2.875::DOUBLE"
)

LABELLED = f"""{IMAGES},{nearest('nn', 'unknown', 'known', 1, label='dataset')}"""

REPORT = f"""{LABELLED},
cells AS (SELECT dataset AS label, neighbor_dataset AS pred, count(*) AS n FROM nn GROUP BY ALL),
names AS (SELECT label AS c FROM cells UNION SELECT pred FROM cells),
raw AS (
  SELECT c, coalesce((SELECT sum(n) FROM cells WHERE label = c), 0) AS support,
         coalesce((SELECT sum(n) FROM cells WHERE pred = c), 0) AS predicted,
         coalesce((SELECT sum(n) FROM cells WHERE pred = c AND label = c), 0) AS hits
  FROM names),
pr AS (
  SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE hits::DOUBLE / predicted END AS p,
         CASE WHEN support = 0 THEN 0 ELSE hits::DOUBLE / support END AS r FROM raw),
f AS (SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f1 FROM pr)
SELECT c AS class, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1_score,
       support::BIGINT AS support FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(hits)::DOUBLE / sum(support), 6), sum(support)::BIGINT FROM f
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f1), 6), sum(support)::BIGINT FROM f
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6),
  round(sum(r * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM f"""


def silhouette(rows: str, label: str) -> str:
    return f"""
sizes AS (SELECT {label}, count(*) AS n FROM {rows} GROUP BY 1),
means AS (
  SELECT a.image_id, a.{label}, b.{label} AS other, sum({PLAIN.format(a='a.v', b='b.v')}) AS total
  FROM {rows} a, {rows} b GROUP BY ALL),
ab AS (
  SELECT m.image_id, m.{label}, any_value(o.n) AS n,
         max(m.total) FILTER (other = m.{label}) / nullif(any_value(o.n) - 1, 0) AS a,
         min(m.total / s.n) FILTER (other <> m.{label}) AS b
  FROM means m JOIN sizes s ON s.{label} = m.other JOIN sizes o ON o.{label} = m.{label}
  GROUP BY m.image_id, m.{label}),
sil AS (
  SELECT image_id, {label}, CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM ab)"""


def weight(o: str, i: str, shift: int) -> str:
    return f"((({o} * 7 + {i} * 13 + {shift}) % 11 - 5) / 10.0::DOUBLE)"


LINEAR = f"""
WITH z AS (
  SELECT vec_id AS image_id, o AS pos,
         sum(embedding[i + 1]::DOUBLE * {weight('o', 'i', 0)}) + (o % 3 - 1) / 10.0::DOUBLE AS z
  FROM embeddings, range(16) a(o), range(64) b(i) GROUP BY vec_id, o)
SELECT image_id, pos, round(z / greatest(sqrt(sum(z * z) OVER (PARTITION BY image_id)), 1e-12), 6) AS value
FROM z"""

# The error function by its power series, which converges fast for these sizes.
ERF = (
    "(2 / sqrt(pi()) * list_sum(list_transform(range(0, 80), lambda n: "
    "pow(-1, n) * pow({x}, 2 * n + 1) / (gamma(n + 1) * (2 * n + 1)))))"
)

NONLINEAR = f"""
WITH h AS (
  SELECT vec_id AS image_id, o,
         sum(embedding[i + 1]::DOUBLE * {weight('o', 'i', 0)}) + (o % 3 - 1) / 10.0::DOUBLE AS h
  FROM embeddings, range(32) a(o), range(64) b(i) GROUP BY vec_id, o),
g AS (SELECT image_id, o AS i, 0.5::DOUBLE * h * (1 + {ERF.format(x='(h / sqrt(2))')}) AS g FROM h),
z AS (
  SELECT image_id, o AS pos, sum(g * {weight('o', 'i', 3)}) + (o % 3 - 1) / 10.0::DOUBLE AS z
  FROM g, range(16) a(o) GROUP BY image_id, o)
SELECT image_id, pos, round(z / greatest(sqrt(sum(z * z) OVER (PARTITION BY image_id)), 1e-12), 6) AS value
FROM z"""

# CRC-32 of the id's text: per byte eight shifts, with the reversed polynomial.
CRC_BUCKET = """
SELECT vec_id AS image_id, xor(list_reduce(
  list_transform(string_split(vec_id::VARCHAR, ''), lambda c: ord(c)::BIGINT),
  lambda crc, b: list_reduce([1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[],
    lambda a, step: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, xor(crc, b)),
  4294967295::BIGINT), 4294967295) % 10 AS sample_id
FROM embeddings"""

ELEMENTS = """SELECT vec_id AS image_id, i AS pos, round({value}, 6) AS value
FROM embeddings, range({n}) t(i)"""

RUNS = f"""
WITH {PART_ROWS},{null_stats('nd', 'train', (5,))},{nearest('nn', 'val', 'train', 5)},
{grid(-8, 8, 100)},{sweep('swept', 'nn', 'val', 'train', 'nd_s')}"""


def experiment(ks: tuple[int, ...]) -> str:
    return f"""
WITH {PART_ROWS},{null_stats('nd', 'train', ks)},{nearest('nn', 'val', 'train', max(ks))},
{grid(-8, 8, 100)},{sweep('swept', 'nn', 'val', 'train', 'nd_s')}
SELECT {SWEPT_ALL} FROM swept"""


def components(squarings: int = 24) -> str:
    """CTEs for the first two loadings: a covariance matrix squared over and over leaves its dominant vector."""
    steps = []
    for part in (1, 2):
        steps.append(
            f"m{part}_0 AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM c{part} WHERE i = j) AS v FROM c{part})"
        )
        for n in range(squarings):
            steps.append(
                f"q{part}_{n} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v "
                f"FROM m{part}_{n} a JOIN m{part}_{n} b ON a.j = b.i GROUP BY a.i, b.j)"
            )
            steps.append(
                f"m{part}_{n + 1} AS MATERIALIZED ("
                f"SELECT i, j, v / (SELECT sum(v) FROM q{part}_{n} WHERE i = j) AS v FROM q{part}_{n})"
            )
        last = f"m{part}_{squarings}"
        steps.append(
            f"raw{part} AS (SELECT i, v FROM {last} WHERE j = (SELECT i FROM {last} WHERE i = j ORDER BY v DESC LIMIT 1))"
        )
        steps.append(
            f"w{part} AS MATERIALIZED (SELECT i, v / sqrt((SELECT sum(v * v) FROM raw{part})) "
            f"* (SELECT sign(v) FROM raw{part} ORDER BY abs(v) DESC LIMIT 1) AS v FROM raw{part})"
        )
        if part == 1:
            steps.append(
                "big AS (SELECT sum(a.v * c1.v * b.v) AS v FROM c1 JOIN w1 a ON a.i = c1.i JOIN w1 b ON b.i = c1.j)"
            )
            steps.append(
                "c2 AS MATERIALIZED (SELECT c1.i, c1.j, c1.v - (SELECT v FROM big) * a.v * b.v AS v "
                "FROM c1 JOIN w1 a ON a.i = c1.i JOIN w1 b ON b.i = c1.j)"
            )
    return ",\n".join(steps)


PCA = f"""
WITH e AS (SELECT vec_id, i, embedding[i + 1]::DOUBLE AS x FROM embeddings, range(64) t(i)),
mean AS (SELECT i, avg(x) AS m FROM e GROUP BY i),
centred AS MATERIALIZED (SELECT vec_id, i, x - m AS x FROM e JOIN mean USING (i)),
c1 AS MATERIALIZED (
  SELECT a.i, b.i AS j, sum(a.x * b.x) AS v FROM centred a JOIN centred b USING (vec_id) GROUP BY a.i, b.i),
{components()}
SELECT vec_id AS image_id, round(sum(x * w1.v), 6) AS first, round(sum(x * w2.v), 6) AS second
FROM centred JOIN w1 USING (i) JOIN w2 USING (i) GROUP BY vec_id"""


SQL: dict[str, str] = {
    # counts and profiles
    "identity_count": f"WITH {ELIGIBLE} SELECT * FROM counted",
    "frequent_filter": f"WITH {ELIGIBLE} SELECT * FROM eligible",
    "count_by_key": "SELECT event_type, count(*) AS count FROM events GROUP BY 1",
    "freq_of_freq": f"""WITH {IMAGES}
SELECT freq, count(*) AS count
FROM (SELECT count(*) AS freq FROM known GROUP BY identity) GROUP BY freq""",
    "describe_counts": """
SELECT count(*) AS count, round(avg(c), 6) AS mean, round(stddev_samp(c), 6) AS stddev,
       min(c) AS min, max(c) AS max FROM (SELECT count(*) AS c FROM events GROUP BY user_id)""",
    "nunique": f"""WITH {IMAGES}
SELECT count(*) AS with_null, count(identity) AS without_null
FROM (SELECT DISTINCT identity FROM images)""",
    "profile_topn": """
SELECT source, count(*) AS count FROM documents WHERE source IS NOT NULL
GROUP BY 1 ORDER BY count DESC, source LIMIT 3""",
    "profile_slice": """
SELECT source, count(*) AS count FROM documents WHERE source IS NOT NULL
GROUP BY 1 ORDER BY count DESC, source LIMIT 10 OFFSET 3""",
    "species_profile": f"""WITH {SPECIES},
leaders AS (
  SELECT identity, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, identity) AS place
  FROM relabelled WHERE identity IS NOT NULL GROUP BY 1)
SELECT 'species' AS section, species AS value, count(*) AS count FROM relabelled GROUP BY species
UNION ALL
SELECT CASE WHEN place <= 3 THEN 'top' ELSE 'next' END, identity, n FROM leaders WHERE place <= 13""",
    "relabel": f"WITH {SPECIES} SELECT * FROM relabelled",
    "run_lengths": """
WITH p AS (SELECT lang, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM documents),
m AS (SELECT *, coalesce((lag(lang) OVER (ORDER BY p) IS DISTINCT FROM lang)::INT, 1) AS fresh FROM p),
r AS (SELECT *, sum(fresh) OVER (ORDER BY p) AS run FROM m)
SELECT min(p) AS start, any_value(lang) AS name, count(*) AS length FROM r GROUP BY run""",
    "label_encode": f"""WITH {IMAGES}
SELECT image_id, identity, dense_rank() OVER (ORDER BY identity) - 1 AS label_id FROM known""",
    # projections, filters and scalars
    "path_parts": r"""
WITH p AS (SELECT page_id, string_split_regex(regexp_replace(url, '/+$', ''), '/+') AS s FROM pages)
SELECT page_id, s[-1] AS last, s[-2] AS second_last, s[-3] AS third_last FROM p""",
    "file_suffix": r"""
SELECT regexp_extract(url, '[^/](\.[^./]+)/*$', 1) AS suffix, count(*) AS count FROM pages GROUP BY 1""",
    "relative_path": "SELECT doc_id, 'images/' || lang || '/' || doc_id || '.png' AS path FROM documents",
    "name_prefix": f"WITH {IMAGES} SELECT image_id, split_part(identity, '_', 1) AS prefix FROM images",
    "key_value": """
SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN label END AS epoch_number FROM embeddings""",
    "like_filter": "SELECT doc_id, source FROM documents WHERE source LIKE '%rc1%'",
    "in_list": "SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'fr')",
    "known_unknown": f"""WITH {IMAGES}
SELECT dataset, identity IS NOT NULL AS known, count(*) AS count FROM images GROUP BY ALL""",
    "hash_sample": CRC_BUCKET,
    "struct_fields": f"""
SELECT image_id, count(cls)::INT AS cls_size, count(avg_patch)::INT AS avg_patch_size,
       round(max(cls) FILTER (pos = 0), 6) AS first_cls, round(max(cls) FILTER (pos = 15), 6) AS last_cls,
       round(max(avg_patch) FILTER (pos = 0), 6) AS first_avg, round(max(avg_patch) FILTER (pos = 15), 6) AS last_avg
FROM ({TOKENS}) GROUP BY image_id""",
    "token_pool": f"""
SELECT image_id, pos, round(cls, 6) AS cls, round(avg_patch, 6) AS avg_patch FROM ({TOKENS})""",
    "rename_columns": "SELECT doc_id, quality AS freq, 'database' AS split FROM labels",
    "vector_text": "SELECT doc_id, concat_ws(',', doc_id, quality, toxic) AS token FROM labels",
    "prefix_truncate": ELEMENTS.format(value="embedding[i + 1]::DOUBLE", n=16),
    "l2_normalise": """
WITH e AS (SELECT vec_id AS image_id, i AS pos, (embedding[i + 1] * 3.0::DOUBLE) AS x FROM embeddings, range(64) t(i))
SELECT image_id, pos, round(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY image_id)), 1e-12), 6) AS value FROM e""",
    "wide_fold": """
SELECT doc_id AS image_id, i AS pos, (CASE i WHEN 0 THEN quality ELSE toxic END)::DOUBLE AS value
FROM labels, range(2) t(i)""",
    "float_cast": ELEMENTS.format(value="(embedding[i + 1]::DOUBLE / 3.0::DOUBLE)::FLOAT::DOUBLE", n=64),
    "score_arithmetic": """
WITH s AS (SELECT event_id, value, abs(value) / (abs(value) + 1.0::DOUBLE) AS share FROM events WHERE value IS NOT NULL)
SELECT event_id, round((value - 10.0::DOUBLE) / (2.0::DOUBLE * 1.4826::DOUBLE), 6) AS z,
       round(sqrt(share * 0.5::DOUBLE), 6) AS geometric,
       round(1.0::DOUBLE - abs(share - 0.5::DOUBLE), 6) AS crossover,
       round(greatest(value - 10.0::DOUBLE, 0), 6) AS hinge FROM s""",
    # joins and set operations
    "metadata_join": """
SELECT doc_id, lang, source, quality, toxic FROM documents JOIN labels USING (doc_id)""",
    "path_left_join": """
SELECT doc_id, lang, quality FROM documents LEFT JOIN labels USING (doc_id)""",
    "anti_join_missing": """
SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "semi_join": "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "left_join_back": """
SELECT doc_id, d.source, lang, toxic_docs FROM documents d LEFT JOIN (
  SELECT source, count(*) AS toxic_docs FROM documents JOIN labels USING (doc_id)
  WHERE toxic = 1 GROUP BY source) t ON t.source = d.source""",
    "positional": """
SELECT d.row_number, doc_id, vec_id, label
FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_number FROM documents) d
JOIN (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS row_number FROM embeddings) e
  ON d.row_number = e.row_number""",
    "union_parts": f"WITH {PARTS} SELECT image_id, part FROM parts WHERE part IN ('train', 'val')",
    "identity_difference": f"""WITH {PARTS}
SELECT identity FROM parts WHERE part <> 'train' EXCEPT SELECT identity FROM parts WHERE part = 'train'""",
    "overlap_counts": f"""WITH {PARTS}, d AS (SELECT DISTINCT part, identity FROM parts)
SELECT a.part AS left_part, b.part AS right_part, count(*) AS shared
FROM d a JOIN d b USING (identity) GROUP BY ALL""",
    "distinct_projection": "SELECT DISTINCT lang, source FROM documents",
    "sort_top": """
SELECT event_id, event_type, round(value, 6) AS value FROM events
ORDER BY events.value DESC NULLS LAST, event_id LIMIT 10""",
    # splits
    "openset_split": f"WITH {PARTS} SELECT image_id, identity, part FROM parts",
    "split_summary": f"""WITH {PARTS},
names AS (SELECT * FROM (VALUES ('train'), ('val'), ('test')) t(s)),
kn AS (SELECT DISTINCT identity FROM parts WHERE part = 'train'),
o AS (
  SELECT a.part AS l, b.part AS r, count(DISTINCT a.image_id) AS c
  FROM parts a JOIN parts b USING (image_id) GROUP BY ALL),
base AS (
  SELECT part AS split, count(DISTINCT identity) AS num_individuals, count(*) AS num_images,
         count(DISTINCT identity) FILTER (identity IN (SELECT identity FROM kn)) AS known_individuals
  FROM parts GROUP BY part)
SELECT split, num_individuals, num_images,
       {', '.join(f"coalesce((SELECT c FROM o WHERE l = '{m}' AND r = split), 0) AS {m}_image_overlap" for m in ('train', 'val', 'test'))},
       {', '.join(f"CASE WHEN split = '{m}' THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS {m}_image_pct" for m in ('train', 'val', 'test'))},
       known_individuals,
       CASE WHEN split = 'train' THEN 0 ELSE num_individuals - known_individuals END AS unknown_individuals
FROM base""",
    "identity_split": f"""WITH {ASSIGNED}
SELECT image_id, identity, p AS part FROM eligible JOIN assigned USING (identity)""",
    "early_split": f"""
WITH {parts(assigned(0.6, 0.2), 'n - ceil(0.5::DOUBLE * n)', 'val')} SELECT image_id, identity, part FROM parts""",
    "stratified_split": """
WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1),
t AS (SELECT sum(n)::DOUBLE AS rows, sum(n) - ceil(sum(n) * 0.2::DOUBLE) AS train FROM c),
s AS (SELECT label, floor(n / rows * train) AS whole, floor(n / rows * train) - n / rows * train AS minus, train FROM c, t),
q AS (
  SELECT label, whole + (row_number() OVER (ORDER BY minus, label) <= train - sum(whole) OVER ())::INT AS quota FROM s),
r AS (
  SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || vec_id), vec_id) AS r FROM embeddings)
SELECT vec_id AS image_id, label, CASE WHEN r <= quota THEN 'train' ELSE 'test' END AS part
FROM r JOIN q USING (label)""",
    # neighbours and statistics
    "knn_topk": f"WITH {IMAGES},{nearest('nn', 'unknown', 'known', 10)} SELECT {NEIGHBORS} FROM nn",
    "knn_other_identity": f"""
WITH {IMAGES},{nearest('nn', 'known', 'known', 3, other=True)} SELECT {NEIGHBORS} FROM nn""",
    "row_median_distance": f"""WITH {IMAGES},{null_stats('nd', 'known', (1, 3, 5))}
SELECT image_id, num_neighbors::INT AS num_neighbors, round(distance, 6) AS distance FROM nd_d""",
    "null_distance_summary": f"""WITH {PART_ROWS},{null_stats('nd', 'train', (3,))}
SELECT round(min(distance), 6) AS min_distance, round(max(distance), 6) AS max_distance,
       round(avg(distance), 6) AS mean_distance, round(stddev_pop(distance), 6) AS std_distance,
       round(quantile_cont(distance, 0.75) - quantile_cont(distance, 0.25), 6) AS iqr,
       round(quantile_cont(distance, 0.25), 6) AS q1, round(quantile_cont(distance, 0.75), 6) AS q3,
       round(any_value(s.median), 6) AS median, round(any_value(s.mad), 6) AS mad
FROM nd_d, nd_s s""",
    "median_mad_by_k": f"""WITH {PART_ROWS},{null_stats('nd', 'train', (1, 3, 5, 10, 20))}
SELECT num_neighbors::INT AS num_neighbors, round(median, 6) AS median, round(mad, 6) AS mad FROM nd_s""",
    # predictions
    "vote": f"""WITH {IMAGES},{nearest('nn', 'unknown', 'known', 10)},
tally AS (SELECT image_id, neighbor_identity, count(*) AS n, min(rank) AS f FROM nn GROUP BY ALL)
SELECT image_id, neighbor_identity AS prediction FROM (
  SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, f) AS place FROM tally) WHERE place = 1""",
    "predict_zgate": f"""WITH {PART_ROWS},{null_stats('nd', 'train', (5,))},{nearest('nn', 'val', 'train', 5)},
tally AS (
  SELECT image_id, neighbor_identity, count(*) AS n, min(rank) AS f FROM nn, nd_s
  WHERE distance - median < -0.5::DOUBLE * mad * 1.4826::DOUBLE GROUP BY ALL),
won AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, f) AS place FROM tally)
SELECT v.image_id, coalesce(neighbor_identity, 'new_individual') AS prediction
FROM val v LEFT JOIN won w ON w.image_id = v.image_id AND place = 1""",
    "predict_absolute": f"{VAL_NN1} SELECT image_id, {BY_DISTANCE} AS prediction FROM nn",
    "predict_all_rows": f"""WITH {IMAGES} SELECT image_id, 'new_individual' AS prediction FROM unknown""",
    "closed_set_1nn": f"""{VAL_NN1},
p AS (
  SELECT v.identity, v.identity IN (SELECT identity FROM train) AS is_known,
         avg((coalesce(neighbor_identity, 'unknown') = v.identity)::INT) AS hit,
         avg((coalesce(neighbor_identity, 'unknown') = 'unknown')::INT) AS miss
  FROM val v LEFT JOIN nn USING (image_id) GROUP BY ALL)
SELECT round(avg(hit) FILTER (is_known), 6) AS baks, round(avg(miss) FILTER (NOT is_known), 6) AS baus FROM p""",
    "prediction_counts": f"""{VAL_NN1}, p AS (SELECT {BY_DISTANCE} AS prediction FROM nn)
SELECT count(*) FILTER (prediction = 'new_individual') AS unknown,
       count(*) FILTER (prediction <> 'new_individual') AS known, count(*) AS total FROM p""",
    "baks": f"{SCORED} SELECT round(avg(hit), 6) AS baks FROM per_id WHERE is_known",
    "baus": f"{SCORED} SELECT round(avg(miss), 6) AS baus FROM per_id WHERE NOT is_known",
    "competition_score": f"{COMPETITION} SELECT round(avg(sqrt(baks * baus)), 6) AS score FROM per_dataset",
    "dataset_scores": f"""{COMPETITION}
SELECT dataset, round(baks, 6) AS baks, round(baus, 6) AS baus, round(sqrt(baks * baus), 6) AS normalized
FROM per_dataset""",
    "submission_violations": f"""WITH {FLAWED}
SELECT 'row count differs' AS rule,
       abs((SELECT count(*) FROM submission) - (SELECT count(*) FROM solution)) AS violations
UNION ALL SELECT 'image_id missing', count(*) FROM solution WHERE image_id NOT IN (SELECT image_id FROM submission)
UNION ALL SELECT 'image_id not in solution', count(*) FROM submission WHERE image_id NOT IN (SELECT image_id FROM solution)
UNION ALL SELECT 'image_id repeated', count(*) FROM (SELECT 1 FROM submission GROUP BY image_id HAVING count(*) > 1)
UNION ALL SELECT 'identity prefix', count(*) FROM submission WHERE identity LIKE 'Fox%'""",
    "submission_alignment": f"""WITH {FLAWED}
SELECT image_id, 'submission' AS missing_from FROM solution WHERE image_id NOT IN (SELECT image_id FROM submission)
UNION ALL
SELECT image_id, 'solution' FROM submission WHERE image_id NOT IN (SELECT image_id FROM solution)""",
    # sweeps
    "threshold_sweep": f"""
WITH {PART_ROWS},{nearest('nn', 'val', 'train', 3)},
fixed AS (SELECT 3 AS num_neighbors, 1.25::DOUBLE AS median, 0.05::DOUBLE AS mad),
{grid(-8, 8, 100)},{sweep('swept', 'nn', 'val', 'train', 'fixed')}
SELECT {SWEPT_ALL} FROM swept""",
    "distance_sweep": f"""
WITH {PART_ROWS},{nearest('nn', 'val', 'train', 1)},
fixed AS (SELECT 1 AS num_neighbors, NULL AS median, NULL AS mad),
{grid(0.8, 1.6, 41)},{sweep('swept', 'nn', 'val', 'train', 'fixed', 'distance <= threshold')}
SELECT {SWEPT} FROM swept""",
    "mad_scaled_sweep": f"""
WITH {PART_ROWS},{null_stats('nd', 'train', (1,))},{nearest('nn', 'val', 'train', 1)},
{grid(-2, 2, 21)},{sweep('swept', 'nn', 'val', 'train', 'nd_s', 'distance <= median + threshold * mad')}
SELECT round(cut, 6) AS threshold, round(baks, 6) AS baks, round(baus, 6) AS baus,
       round(crossover_score, 6) AS crossover_score, round(score, 6) AS score,
       round((cut - median) / mad, 6) + 0.0 AS multiplier
FROM (SELECT *, median + threshold * mad AS cut FROM swept)""",
    "distance_experiment": experiment((1,)),
    "k_sweep": experiment((1, 3, 5, 10, 20)),
    "best_threshold": f"""{RUNS}
SELECT {SWEPT_ALL} FROM (
  SELECT *, row_number() OVER (ORDER BY score DESC NULLS LAST, threshold) AS place FROM swept) s
WHERE place = 1""",
    "sweep_maxima": f"""{RUNS}
SELECT round(max(baks), 6) AS baks, round(max(baus), 6) AS baus, round(max(score), 6) AS score FROM swept""",
    "final_labels": f"""
WITH {PART_ROWS},{null_stats('nd', 'train_val', (3,))},{nearest('nn', 'test', 'train_val', 3)},
{grid(-8, 8, 100)},{sweep('swept', 'nn', 'test', 'train_val', 'nd_s')},
best AS (SELECT threshold, median, mad FROM swept ORDER BY score DESC NULLS LAST, threshold LIMIT 1),
{nearest('fin', 'unknown', 'known', 3)},
tally AS (
  SELECT image_id, neighbor_identity, count(*) AS n, min(rank) AS f FROM fin, best WHERE {GATE} GROUP BY ALL),
won AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, f) AS place FROM tally)
SELECT u.image_id, coalesce(w.neighbor_identity, 'new_individual') AS identity
FROM unknown u LEFT JOIN won w ON w.image_id = u.image_id AND place = 1""",
    "dataset_only": f"""
WITH {IMAGES}, k AS (SELECT * FROM known WHERE dataset = 'SalamanderID2025'),
u AS (SELECT * FROM unknown WHERE dataset = 'SalamanderID2025'),{nearest('nn', 'u', 'k', 1)}
SELECT {NEIGHBORS} FROM nn""",
    # vectors, triplets and losses
    "centroid": f"""WITH {IMAGES}
SELECT identity, i AS pos, round(avg(v[i + 1]::DOUBLE), 6) AS value FROM known, range(64) t(i) GROUP BY identity, i""",
    "triplet_filter": f"WITH {DATABASE} SELECT image_id, identity FROM database",
    "positive_sample": f"WITH {positives(2)} SELECT anchor_id, draw::INT AS draw, positive_id FROM positives",
    "negative_sample": f"WITH {negatives('')}",
    "negative_sample_same_dataset": f"WITH {negatives('dataset')}",
    "candidate_counts": f"""WITH {DATABASE}
SELECT image_id, count(*) OVER (PARTITION BY identity) - 1 AS positives,
       count(*) OVER () - count(*) OVER (PARTITION BY identity) AS negatives,
       count(*) OVER (PARTITION BY dataset) - count(*) OVER (PARTITION BY dataset, identity) AS negatives_same_dataset
FROM database""",
    "batch_distances": f"""WITH {DATABASE},{BATCHED},
d AS (
  SELECT a.image_id, a.batch, {PLAIN.format(a='a.v', b='b.v')} AS d
  FROM batched a JOIN batched b ON a.batch = b.batch AND a.image_id <> b.image_id)
SELECT image_id, batch, count(*)::INT AS others, round(min(d), 6) AS nearest, round(max(d), 6) AS farthest,
       round(avg(d), 6) AS mean FROM d GROUP BY ALL""",
    "semi_hard": f"""WITH {MINED}
SELECT batch, anchor_id, draw::INT AS draw, positive_id, negative_id, round(dp, 6) AS dp, round(dn, 6) AS dn FROM mined""",
    "triplet_loss": f"WITH {MINED} SELECT round(avg({hinge(64)}), 6) AS loss, count(*) AS triplets FROM mined",
    "nested_loss": f"WITH {MINED} SELECT round(avg({NESTED}), 6) AS loss, count(*) AS triplets FROM mined",
    "epoch_loss": f"""WITH {MINED}, b AS (SELECT batch, avg({NESTED}) AS l, count(*) AS n FROM mined GROUP BY batch)
SELECT round(avg(l), 6) AS loss, count(*) AS batches, sum(n)::BIGINT AS triplets FROM b""",
    # reports
    "accuracy": """
SELECT round(avg((quality = toxic)::INT), 6) AS accuracy, round(100.0::DOUBLE * avg((quality = toxic)::INT), 6) AS accuracy_pct
FROM labels""",
    "class_report": f"WITH {REPORT}",
    "confusion": f"""WITH {LABELLED}
SELECT dataset AS label, neighbor_dataset AS prediction, count(*) AS count FROM nn GROUP BY ALL""",
    "silhouette": f"WITH {IMAGES},{silhouette('known', 'identity')} SELECT round(avg(s), 6) AS silhouette FROM sil",
    "silhouette_rows": f"""WITH {IMAGES},{silhouette('images', 'label')}
SELECT image_id, label::VARCHAR AS label, round(s, 6) AS silhouette FROM sil""",
    # models
    "linear_projection": LINEAR,
    "nonlinear_projection": NONLINEAR,
    "batch_embed": """
SELECT doc_id, strlen(text) AS bytes, length(text) - length(replace(text, ' ', '')) AS spaces FROM documents""",
    "pca": PCA,
}
