"""DuckDB SQL for the registered queries, written apart from the operators."""

from __future__ import annotations

BUCKETS = "b(bucket_id, bucket, bw, bh) AS (VALUES (0,'1:1',768,768),(1,'4:5',608,768),(2,'5:4',768,608),(3,'4:3',768,576),(4,'3:4',576,768),(5,'3:2',768,512),(6,'2:3',512,768),(7,'16:9',768,448),(8,'9:16',448,768))"
IMAGES = "im AS (SELECT o_orderkey::BIGINT AS image_id, (320 + (o_custkey * 7919) % 3841)::INT AS width, (240 + (o_orderkey * 104729) % 2161)::INT AS height FROM orders)"
#: The exact integer rule for the default table: squares of ratios against products of neighbouring ratios.
RULE = """CASE WHEN width >= height THEN
  CASE WHEN 19 * w * w < 24 * h * h THEN 0 WHEN 19 * w * w < 32 * h * h THEN 2 WHEN w * w < 2 * h * h THEN 3 WHEN 7 * w * w < 18 * h * h THEN 5 ELSE 7 END
  ELSE CASE WHEN 19 * h * h < 24 * w * w THEN 0 WHEN 19 * h * h < 32 * w * w THEN 1 WHEN h * h < 2 * w * w THEN 4 WHEN 7 * h * h < 18 * w * w THEN 6 ELSE 8 END END"""
ASSIGNED = f"{BUCKETS}, {IMAGES}, ia AS (SELECT image_id, width, height, {RULE} AS k FROM (SELECT *, width::BIGINT AS w, height::BIGINT AS h FROM im)), a AS (SELECT image_id, width, height, bucket_id, bucket, bw, bh FROM ia JOIN b ON k = bucket_id)"


def cover(margin: str) -> str:
    s = f"(greatest(bw / width, bh / height) * {margin}::DOUBLE)"
    return f"{ASSIGNED}, c AS (SELECT image_id, bucket_id, bw, bh, greatest(bw::BIGINT, round_even(width * {s}, 0)::BIGINT) AS new_w, greatest(bh::BIGINT, round_even(height * {s}, 0)::BIGINT) AS new_h FROM a)"


def _keys(*parts: str) -> str:
    """The six keys of a permutation, with the side of the rectangle that each round takes."""
    one = "('0x' || substr(md5({0} || ':{1}'), 1, 8))::BIGINT"
    return ", ".join(f"{{{{'l': 0::BIGINT, 'r': 0::BIGINT, 'k': {one.format(' || '.join(parts), i)}, 'm': {'ab'[i % 2]}}}}}" for i in range(6)).replace("{{", "{").replace("}}", "}")


def _permuted(x: str, keys: str) -> str:
    """Where x goes, in a relation with n, the sides a and b, and keys."""
    t = "((s.r * 1597334677 + e.k) % 2147483647)"
    once = f"list_reduce(list_concat([{{'l': ({{0}}) % a, 'r': ({{0}}) // a, 'k': 0::BIGINT, 'm': 0::BIGINT}}], {keys}), lambda s, e: {{'l': s.r, 'r': (s.l + {t} * {t} % 2147483647) % e.m, 'k': 0::BIGINT, 'm': 0::BIGINT}})"
    place = "({0}).r * a + ({0}).l"
    whole = place.format(once)
    return f"list_reduce(list_concat([{whole.replace('{0}', x)}], list_transform(range(24), lambda i: -1::BIGINT)), lambda v, w: CASE WHEN v < n THEN v ELSE {whole.replace('{0}', 'v')} END)"


def plan(items: str, key: str, bucket: str, drop_last: bool) -> str:
    full = "n // 8" if drop_last else "(n + 7) // 8"
    sides = lambda n: f"ceil(sqrt({n}::DOUBLE))::BIGINT"
    return f"""ix AS (SELECT {key}, {bucket}, row_number() OVER (PARTITION BY {bucket} ORDER BY ('0x' || substr(md5('index:' || {key}), 1, 8))::BIGINT, {key}) - 1 AS place FROM {items}),
 bk AS (SELECT *, sum({full}) OVER (ORDER BY {bucket})::BIGINT - {full} AS first_, sum({full}) OVER ()::BIGINT AS total, {full} AS full_, [{_keys("'42:0:'", bucket)}] AS ks
   FROM (SELECT {bucket}, n, {sides('n')} AS a, ceil(n / {sides('n')})::BIGINT AS b FROM (SELECT {bucket}, count(*) AS n FROM ix GROUP BY ALL))),
 lo AS (SELECT {key}, {bucket}, first_, total, full_, {_permuted('place', 'ks')} AS dest FROM ix JOIN bk USING ({bucket})),
 fu AS (SELECT {key}, {bucket}, dest % 8 AS pos, first_ + dest // 8 AS x, total AS n, {sides('total')} AS a, ceil(total / {sides('total')})::BIGINT AS b FROM lo WHERE dest // 8 < full_),
 plan AS (SELECT {_permuted('x', '[' + _keys("'42:0:batch'") + ']')} AS batch_no, {bucket}, pos, {key} FROM fu)"""


PLAN = f"{ASSIGNED}, {plan('a', 'image_id', 'bucket_id', True)}"
SHARDS = f"{PLAN}, t AS (SELECT max(batch_no) + 1 AS total FROM plan), s AS (SELECT batch_no % 2 AS rank, batch_no // 2 AS local_no, batch_no, bucket_id, pos, image_id FROM plan, t WHERE batch_no // 2 < total // 2)"
VECTORS = "v AS (SELECT vec_id::BIGINT AS vec_id, label::BIGINT AS label, embedding::DOUBLE[] AS z FROM embeddings), cb AS (SELECT vec_id AS code, z AS e FROM v WHERE vec_id < 32)"
SQ = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: ({0}[i] - {1}[i]) ** 2))"
AB = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: abs({0}[i] - {1}[i])))"


def near(vectors: str, codebook: str, out: str) -> str:
    return f"{out} AS (SELECT vec_id, label, z, code, e, d FROM (SELECT vec_id, label, z, code, e, {SQ.format('z', 'e')} AS d, row_number() OVER (PARTITION BY vec_id ORDER BY {SQ.format('z', 'e')}, code) AS k FROM {vectors}, {codebook}) WHERE k = 1)"


TOKENS = f"{VECTORS}, {near('v', 'cb', 'tok')}"
DEAD = f"{TOKENS}, dead AS (SELECT window_no, code FROM (SELECT DISTINCT vec_id // 100 AS window_no FROM v), cb WHERE (window_no, code) NOT IN (SELECT (vec_id // 100, code) FROM tok))"
HIST = f"{TOKENS}, hist AS (SELECT cb.code, count(tok.code) AS n FROM cb LEFT JOIN tok ON cb.code = tok.code GROUP BY cb.code)"
UNIT = "(greatest(-1.0, least(1.0, {0})) + 1) / 2"
PSNR = f"10 * log10(1.0 / greatest(list_sum(list_transform(range(1, 65), lambda i: ({UNIT.format('z[i]')} - {UNIT.format('e[i]')}) ** 2)) / 64, 1e-10))"
METRICS = f"{TOKENS}, m AS (SELECT vec_id, label, {AB.format('z', 'e')} / 64 AS l1, {PSNR} AS psnr FROM tok)"
EVENTS = "te AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS step, event_type AS bucket, value::DOUBLE AS seconds FROM events)"
CHECKPOINTS = "ck AS (SELECT step, step // 3000 AS epoch, step % 3000 * 8 AS batch_offset FROM (SELECT unnest(range(250, (SELECT count(*) + 1 FROM events), 250)) AS step))"
PATHS = "pa AS (SELECT doc_id::BIGINT AS image_id, 'img/' || ['a', 'a-b', 'a/b', 'Z'][doc_id % 4 + 1] || '/f' || doc_id || ['.jpg', '.JPEG', '.png', '.Webp', '.bmp', '.txt', '.jpg.gz'][doc_id % 7 + 1] AS path FROM documents), pf AS (SELECT * FROM pa WHERE regexp_matches(path, '\\.(jpg|jpeg|png|webp|bmp)$', 'i'))"
HASH = "('0x' || substr(md5('42:0:' || image_id || ':{0}'), 1, 8))::BIGINT"
SOFTPLUS = "(greatest({0}, 0.0) + ln(1 + exp(-abs({0}))))"
SHARD_COLUMNS = "rank, local_no, batch_no, pos, image_id"


def resized(out: str, source: str, size: str, new: str, offset: str, places: str, keep: str) -> str:
    """Weights of a bicubic pass along one side, in whole numbers, and what it makes of ``source`` (image_id, {keep}, j, v) at ``places`` from ``offset`` on."""
    x = "abs((j + 0.5 - (i + 0.5) * {0} / {1}) / greatest({0} / {1}, 1.0))".format(size, new)
    return f"""{out}_k AS (SELECT {size}, {new}, i, j, CASE WHEN x < 1 THEN (1.5 * x - 2.5) * x * x + 1 WHEN x < 2 THEN ((2.5 - 0.5 * x) * x - 4) * x + 2 ELSE 0.0 END AS k FROM (
   SELECT {size}, {new}, i, j, {x} AS x FROM (SELECT {size}, {new}, i, unnest(range({size})) AS j FROM (SELECT {size}, {new}, unnest(range({new})) AS i FROM (SELECT DISTINCT {size}, {new} FROM pl))))),
 {out}_w AS (SELECT {size}, {new}, i, j, (floor(abs(n) * 4194304 + 0.5) * sign(n))::BIGINT AS k FROM (SELECT *, k / sum(k) OVER (PARTITION BY {size}, {new}, i) AS n FROM {out}_k)),
 {out} AS (SELECT image_id, {keep}, w.i - {offset} AS o, greatest(0, least(255, floor((sum(w.k * v) + 2097152) / 4194304)))::BIGINT AS v
   FROM {source} JOIN pl USING (image_id) JOIN {out}_w w USING ({size}, {new}, j) WHERE w.i >= {offset} AND w.i < {offset} + {places} GROUP BY ALL)"""


SMALL = f"""{VECTORS}, sm AS (SELECT vec_id AS image_id, CASE label % 2 WHEN 0 THEN 4 ELSE 10 END AS width, CASE label % 2 WHEN 0 THEN 5 ELSE 2 END AS height, CASE label % 2 WHEN 0 THEN 0 ELSE 1 END AS bucket_id, CASE label % 2 WHEN 0 THEN 32 ELSE 64 END AS bw, 32 AS bh, z FROM v),
 sc AS (SELECT *, greatest(bw / width, bh / height) * 1.05::DOUBLE AS s FROM sm),
 sz AS (SELECT *, greatest(bw, round_even(width * s, 0)::BIGINT) AS new_w, greatest(bh, round_even(height * s, 0)::BIGINT) AS new_h FROM sc),
 pl AS (SELECT *, {HASH.format('left')} % (new_w - bw + 1) AS lft, {HASH.format('top')} % (new_h - bh + 1) AS tp, {HASH.format('flip')} % 2 = 1 AS flp FROM sz),
 px AS (SELECT image_id, (n - 1) % 3 AS c, (n - 1) // 3 % width AS j, (n - 1) // 3 // width AS y, floor({UNIT.format('z[n]')} * 255)::BIGINT AS v FROM (SELECT image_id, width, z, unnest(range(1, 61)) AS n FROM sm)),
 {resized('ph', 'px', 'width', 'new_w', 'lft', 'bw', 'c, y')},
 pv_in AS (SELECT image_id, c, o AS x, y AS j, v FROM ph),
 {resized('pv', 'pv_in', 'height', 'new_h', 'tp', 'bh', 'c, x')},
 pf AS (SELECT image_id, c, v, o * bw + CASE WHEN flp THEN bw - 1 - x ELSE x END + 1 AS place FROM pv JOIN pl USING (image_id)),
 ps AS (SELECT image_id, c AS i, sum(v)::BIGINT AS total FROM pf GROUP BY ALL UNION ALL SELECT image_id, c + 3, sum(v * place)::BIGINT FROM pf GROUP BY ALL)"""

GRIDS = f"""{SMALL}, {plan('sm', 'image_id', 'bucket_id', True)}, co AS (SELECT code, e[1:3] AS e FROM cb),
 ce AS (SELECT image_id, bw // 32 AS wide, (place - 1) % bw // 32 AS x, c, avg(v) / 255 * 2 - 1 AS m FROM pf JOIN (SELECT image_id, bw FROM pl) USING (image_id) JOIN (SELECT image_id FROM plan) USING (image_id) GROUP BY ALL),
 cv AS (SELECT image_id, wide, x, list(m ORDER BY c) AS z FROM ce GROUP BY ALL),
 tk AS (SELECT image_id, wide, x, arg_min(code, {{'d': (z[1] - e[1]) ** 2 + (z[2] - e[2]) ** 2 + (z[3] - e[3]) ** 2, 'c': code}}) AS code FROM cv, co GROUP BY ALL)"""


def kmeans(n: int, start: str = "") -> str:
    parts, c = [VECTORS, start] if start else [VECTORS], "st" if start else "cb"
    for k in range(n):
        parts.append(near("v", c, f"t{k}"))
        parts.append(f"s{k} AS (SELECT code, d AS dim, avg(x) AS x FROM (SELECT code, unnest(range(1, 65)) AS d, unnest(z) AS x FROM t{k}) GROUP BY ALL)")
        parts.append(f"n{k} AS (SELECT code, list(x ORDER BY dim) AS e FROM s{k} GROUP BY code)")
        parts.append(f"c{k} AS (SELECT {c}.code, coalesce(n{k}.e, {c}.e) AS e FROM {c} LEFT JOIN n{k} ON {c}.code = n{k}.code)")
        c = f"c{k}"
    return f"WITH {', '.join(parts)} SELECT code, unnest(range(0, 64)) AS dim, round(unnest(e), 5) AS v FROM {c}"


def trained(k: int) -> str:
    """State q<k + 1> after a step on the vectors of ids k mod 2."""
    return f"""b{k} AS (SELECT * FROM v WHERE vec_id % 2 = {k}), c{k} AS (SELECT code, list(e ORDER BY dim) AS e FROM q{k} GROUP BY code), {near(f'b{k}', f'c{k}', f't{k}')},
 m{k} AS (SELECT code, dim, count(*) AS k, sum(x) AS x FROM (SELECT code, unnest(range(0, 64)) AS dim, unnest(z) AS x FROM t{k}) GROUP BY ALL),
 a{k} AS (SELECT q.code, q.dim, 0.99::DOUBLE * s + 0.01::DOUBLE * coalesce(x, 0) AS s, 0.99::DOUBLE * n + 0.01::DOUBLE * coalesce(k, 0) AS n, u + coalesce(k, 0) AS u FROM q{k} q LEFT JOIN m{k} m USING (code, dim)),
 q{k + 1} AS (SELECT code, dim, s / ((n + 1e-5) / (total + codes * 1e-5) * total) AS e, s, n, u FROM a{k}, (SELECT sum(n) AS total, count(*) AS codes FROM a{k} WHERE dim = 0))"""


_SETTING = """SELECT 'run' || user_id || '.' || CASE event_type WHEN 'click' THEN 'codebook_size' WHEN 'view' THEN 'use_ema' ELSE event_type END AS key,
   (arg_max({{'v': CASE WHEN {0} = 1 AND round(value * 100)::BIGINT % 3 = 0 THEN NULL ELSE round(value * 100)::BIGINT::VARCHAR END}}, event_id)).v AS value FROM events WHERE event_id % 2 = {0} GROUP BY 1"""
SETTINGS = f"a AS ({_SETTING.format(0)}), o AS ({_SETTING.format(1)})"


ORACLES = {
    "catalog_filter": f"WITH {PATHS} SELECT image_id, path FROM pf",
    "catalog_count": f"WITH {PATHS} SELECT count(*) AS n_images FROM pf",
    "catalog_order": f"WITH {PATHS} SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) - 1 AS place FROM pf",
    "bucket_geometry": f"WITH {ASSIGNED} SELECT bucket_id, bucket, bw, bh, bw / bh AS aspect_ratio, (bh // 32)::BIGINT AS grid_h, (bw // 32)::BIGINT AS grid_w, ((bh // 32) * (bw // 32))::BIGINT AS num_tokens, n_images, n_images * (bh // 32) * (bw // 32) AS total_tokens FROM b JOIN (SELECT bucket_id, count(*) AS n_images FROM a GROUP BY ALL) USING (bucket_id)",
    "bucket_assign": f"WITH {ASSIGNED} SELECT image_id, width, height, bucket_id, bucket FROM a",
    "bucket_assign_join": f"WITH {BUCKETS}, {IMAGES} SELECT image_id, bucket_id, bucket FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY abs(ln(bw / bh) - ln(width / height)), bucket_id) AS k FROM im, b) WHERE k = 1",
    "bucket_counts": f"WITH {ASSIGNED} SELECT bucket_id, bucket, count(*) AS n_images, (count(*) // 8)::BIGINT AS full_batches FROM a GROUP BY ALL",
    "steps_per_epoch": f"WITH {ASSIGNED}, n AS (SELECT bucket_id, count(*) // 8 AS f FROM a GROUP BY ALL) SELECT sum(f)::BIGINT AS batches, (sum(f)::BIGINT // 2 // 8)::BIGINT AS steps_per_epoch, (sum(f)::BIGINT // 2 // 8 * 30)::BIGINT AS total_steps FROM n",
    "cover_geometry": f"WITH {cover('1.0')} SELECT * FROM c",
    "cover_geometry_train": f"WITH {cover('1.05')} SELECT * FROM c",
    "center_crop_box": f"WITH {cover('1.0')} SELECT image_id, round_even(((new_w - bw) / 2.0)::DOUBLE, 0)::BIGINT AS \"left\", round_even(((new_h - bh) / 2.0)::DOUBLE, 0)::BIGINT AS top, bw, bh FROM c",
    "augment_plan": f"WITH {cover('1.05')} SELECT image_id, {HASH.format('left')} % (new_w - bw + 1) AS \"left\", {HASH.format('top')} % (new_h - bh + 1) AS top, {HASH.format('flip')} % 2 = 1 AS flip FROM c",
    "model_input": f"WITH {SMALL}, {plan('sm', 'image_id', 'bucket_id', True)} SELECT batch_no, pos, bucket_id, image_id, i, total FROM plan JOIN ps USING (image_id)",
    "encode_images": f"WITH {GRIDS} SELECT image_id, 0::BIGINT AS y, x, code FROM tk",
    "decode_tokens": f"WITH {GRIDS} SELECT image_id, c * wide + x AS i, round(e[c + 1], 6) AS value FROM tk JOIN co USING (code), range(3) r(c)",
    "normalize_roundtrip": f"WITH {VECTORS} SELECT vec_id, round(list_sum(list_transform(z, lambda x: (({UNIT.format('x')}) - 0.5) / 0.5)), 6) AS norm_sum, 0.0::DOUBLE AS back_diff FROM v",
    "batch_plan": f"WITH {PLAN} SELECT * FROM plan",
    "rank_shards": f"WITH {SHARDS} SELECT {SHARD_COLUMNS} FROM s",
    "resume_slice": f"WITH {SHARDS} SELECT {SHARD_COLUMNS} FROM s WHERE rank = 1 AND local_no >= 5",
    "accum_windows": f"WITH {SHARDS} SELECT rank, local_no // 8 AS window_no, count(DISTINCT local_no) AS n_batches, count(*) AS n_images, count(DISTINCT bucket_id) AS n_buckets, local_no // 8 + 1 AS step_in_epoch FROM s GROUP BY rank, local_no // 8 HAVING count(DISTINCT local_no) = 8",
    "eval_limit": f"WITH {ASSIGNED}, r AS (SELECT image_id, bucket_id, row_number() OVER (PARTITION BY bucket_id ORDER BY image_id) AS n FROM a) SELECT image_id, bucket_id, (n - 1) // 8 AS batch_idx FROM r WHERE n <= 16",
    "vq_assign": f"WITH {TOKENS} SELECT vec_id, code, round(d, 6) AS distance FROM tok",
    "vq_decode": f"WITH {TOKENS} SELECT vec_id, code, round(e[1], 6) AS first, round(list_sum(e), 6) AS total FROM tok",
    "code_histogram": f"WITH {HIST} SELECT code, n FROM hist",
    "codebook_perplexity": f"WITH {HIST}, p AS (SELECT n / sum(n) OVER () AS p FROM hist) SELECT round(exp(-sum(p * ln(p))), 6) AS perplexity FROM p WHERE p > 0",
    "codebook_usage": f"WITH {HIST} SELECT count(*) FILTER (n > 0) AS used, round(count(*) FILTER (n > 0) / count(*), 6) AS usage, count(*) FILTER (n > 0) / count(*) < 0.5 AS is_low FROM hist",
    "usage_window": f"WITH {TOKENS} SELECT vec_id // 100 AS window_no, code, count(*) AS n FROM tok GROUP BY ALL",
    "dead_codes": f"WITH {DEAD} SELECT window_no, code FROM dead",
    "revive_plan": f"""WITH {DEAD}, r AS (SELECT *, row_number() OVER (PARTITION BY window_no ORDER BY code) - 1 AS rn FROM dead),
 x AS (SELECT vec_id, vec_id // 100 AS window_no, row_number() OVER (PARTITION BY vec_id // 100 ORDER BY md5('42:revive:' || vec_id), vec_id) - 1 AS vn, count(*) OVER (PARTITION BY vec_id // 100) AS n FROM v)
 SELECT r.window_no, code, vec_id FROM r JOIN x ON r.window_no = x.window_no AND rn % n = vn""",
    "ema_step": f"""WITH {TOKENS}, l AS (SELECT code, unnest(range(0, 64)) AS dim, unnest(e) AS w FROM cb), s AS (SELECT code, dim, count(*) AS n, sum(x) AS s FROM (SELECT code, unnest(range(0, 64)) AS dim, unnest(z) AS x FROM tok) GROUP BY ALL),
 u AS (SELECT l.code, l.dim, 0.99::DOUBLE * 1.0::DOUBLE + 0.01::DOUBLE * coalesce(n, 0) AS ema_n, 0.99::DOUBLE * w + 0.01::DOUBLE * coalesce(s, 0) AS av FROM l LEFT JOIN s ON l.code = s.code AND l.dim = s.dim),
 t AS (SELECT sum(ema_n) AS total, count(*) AS k FROM u WHERE dim = 0)
 SELECT code, dim, round(ema_n, 6) AS ema_n, round(av / ((ema_n + 1e-5) / (total + k * 1e-5) * total), 5) AS weight FROM u, t""",
    "kmeans_step": kmeans(1),
    "kmeans_3": kmeans(3),
    "recon_l1": f"WITH {METRICS} SELECT round(avg(l1), 6) AS recon_l1 FROM m",
    "vq_losses": f"WITH {TOKENS}, q AS (SELECT avg(d / 64) AS c FROM tok) SELECT false AS use_ema, round(c, 6) AS codebook_loss, round(c, 6) AS commitment_loss, round(c * 1.15::DOUBLE, 6) AS loss FROM q UNION ALL SELECT true, 0.0::DOUBLE, round(c, 6), round(c * 0.15::DOUBLE, 6) FROM q",
    "adv_losses": f"""WITH {VECTORS}, f AS (SELECT unnest(z[1:32]) AS r, unnest(z[33:64]) AS k FROM v)
 SELECT 'hinge' AS kind, round(-avg(k), 6) AS generator, round(0.5::DOUBLE * (avg(greatest(0.0, 1 - r)) + avg(greatest(0.0, 1 + k))), 6) AS discriminator FROM f
 UNION ALL SELECT 'non_saturating', round(avg({SOFTPLUS.format('(-k)')}), 6), round(0.5::DOUBLE * (avg({SOFTPLUS.format('(-r)')}) + avg({SOFTPLUS.format('(k)')})), 6) FROM f""",
    "adaptive_weight": f"WITH {TOKENS} SELECT vec_id, round(least(1e4, greatest(0.0, sqrt(list_sum(list_transform(z, lambda x: x * x))) / (sqrt(d) + 1e-4))), 6) AS weight FROM tok",
    "loss_total": f"WITH {METRICS} SELECT m.vec_id, round(l1 + d / 64 * 1.15::DOUBLE + m.label / 10 + 0.1::DOUBLE * CASE WHEN m.vec_id >= 100 THEN -z[1] ELSE 0 END, 6) AS total FROM m JOIN tok USING (vec_id)",
    "psnr_by_bucket": f"WITH {METRICS} SELECT label, round(avg(psnr), 6) AS psnr FROM m GROUP BY label",
    "feature_covariance": f"WITH {VECTORS}, l AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(z) AS x FROM v) SELECT p.i, q.i AS j, round(covar_samp(p.x, q.x), 6) AS cov FROM l p JOIN l q USING (vec_id) GROUP BY p.i, q.i",
    "eval_rollup": f"WITH {METRICS} SELECT label::VARCHAR AS bucket, count(*) AS num_images, round(avg(l1), 6) AS l1, round(avg(psnr), 6) AS psnr, label IS NULL OR count(*) >= 20 AS enough FROM m GROUP BY ROLLUP (label)",
    "kmeans_start": kmeans(2, "st AS (SELECT code, z AS e FROM (SELECT code, row_number() OVER (ORDER BY code) AS n FROM cb) JOIN (SELECT z, row_number() OVER (ORDER BY md5('42:kmeans:' || vec_id), vec_id) AS n FROM v) USING (n))"),
    "revive_codes": f"""WITH {DEAD}, r AS (SELECT *, row_number() OVER (PARTITION BY window_no ORDER BY code) - 1 AS rn FROM dead),
 x AS (SELECT z, vec_id // 100 AS window_no, row_number() OVER (PARTITION BY vec_id // 100 ORDER BY md5('42:revive:' || vec_id), vec_id) - 1 AS vn, count(*) OVER (PARTITION BY vec_id // 100) AS n FROM v),
 w AS (SELECT code, arg_max(z, r.window_no) AS z FROM r JOIN x ON r.window_no = x.window_no AND rn % n = vn GROUP BY code)
 SELECT cb.code, round(list_sum(coalesce(z, e)), 6) AS total, round(list_sum(coalesce(z, e)), 6) AS ema_total, CASE WHEN z IS NULL THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END AS ema_n, 0::BIGINT AS usage FROM cb LEFT JOIN w USING (code)""",
    "quick_validation": f"WITH {METRICS}, {plan('v', 'vec_id', 'label', False)}, x AS (SELECT batch_no, label, avg(l1) AS l1 FROM plan JOIN (SELECT vec_id, l1 FROM m) USING (vec_id) WHERE batch_no < 40 GROUP BY ALL) SELECT label::VARCHAR AS bucket, count(*) AS n_batches, round(avg(l1), 6) AS recon_l1 FROM x GROUP BY ROLLUP (label)",
    "validation_scalars": f"WITH {METRICS}, {plan('v', 'vec_id', 'label', False)}, x AS (SELECT batch_no, label, avg(l1) AS l1 FROM plan JOIN (SELECT vec_id, l1 FROM m) USING (vec_id) WHERE batch_no < 40 GROUP BY ALL) SELECT CASE WHEN label IS NULL THEN 'val' ELSE 'val_bucket_' || label::VARCHAR END || '/recon_l1' AS tag, 2000::BIGINT AS step, round(avg(l1), 6) AS value FROM x GROUP BY ROLLUP (label)",
    "telemetry_families": f"""WITH {EVENTS}, s AS (SELECT *, step // 3000 AS epoch, round(least(1.0, (step + 1) / 1500), 6) AS lr FROM te) SELECT 'train/seconds' AS tag, step, seconds AS value FROM s UNION ALL SELECT 'train/epoch', step, epoch::DOUBLE FROM s
 UNION ALL SELECT 'train/lr_generator', step, lr FROM s WHERE step % 50 = 0 UNION ALL SELECT 'train_bucket_' || bucket || '/seconds', step, seconds FROM s WHERE step % 50 = 0""",
    "image_grid": f"""WITH {TOKENS}, f AS (SELECT * FROM tok ORDER BY vec_id LIMIT 4), i AS (SELECT *, unnest(range(0, 128)) AS i FROM f)
 SELECT 'train/input_vs_reconstruction' AS tag, vec_id, i, round((greatest(-1.0, least(1.0, CASE WHEN i % 16 < 8 THEN z[i // 16 * 8 + i % 16 + 1] ELSE e[i // 16 * 8 + i % 16 - 7] END)) + 1) / 2, 6) AS value FROM i""",
    "checkpoint_json": f"WITH {CHECKPOINTS} SELECT to_json({{'step': step, 'epoch': epoch, 'batch_offset': batch_offset}})::VARCHAR AS text, step, batch_offset FROM ck",
    "telemetry_long": f"WITH {EVENTS} SELECT 'train/seconds' AS tag, step, seconds AS value FROM te UNION ALL SELECT 'train_bucket_' || bucket || '/seconds', step, seconds FROM te WHERE step % 50 = 0",
    "step_spikes": f"WITH {EVENTS}, x AS (SELECT *, avg(seconds) OVER (ORDER BY step ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS before FROM te) SELECT step, seconds, round(before, 6) AS before FROM x WHERE seconds > 5 * before",
    "eta_rolling": f"WITH {EVENTS}, x AS (SELECT step, avg(seconds) OVER (ORDER BY step ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS s FROM te) SELECT step, round(s, 6) AS seconds_per_step, round((1000000 - step) * s, 3) AS eta_seconds FROM x",
    "lr_schedule": f"""WITH {EVENTS}, s AS (SELECT step * 40 AS step FROM te) SELECT step, round(4.5e-6 * least(1.0, (step + 1) / 1500) * 1e6, 6) AS lr_generator_e6, step >= 30000 AS discriminator_active,
 round(CASE WHEN step >= 30000 THEN 4.5e-6 * least(1.0, (step - 30000 + 1) / 1500) ELSE 0.0 END * 1e6, 6) AS lr_discriminator_e6 FROM s""",
    "schedule_flags": f"""WITH {EVENTS}, s AS (SELECT step - 1 AS batch_idx, step // 8 AS st, step % 8 = 0 AS e FROM te) SELECT batch_idx, st AS step, e AS is_step, e AND st % 100 = 0 AS revive, e AND st % 50 = 0 AS log, e AND st % 500 = 0 AS image, e AND st % 2000 = 0 AS save, e AND st % 2000 = 0 AS validate FROM s""",
    "format_duration": f"WITH {EVENTS}, s AS (SELECT step, greatest(0, trunc((seconds - 10) * 97)::BIGINT) AS s FROM te) SELECT step, CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') ELSE lpad((s // 60)::VARCHAR, 2, '0') END || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS text FROM s",
    "ckpt_retention": f"WITH {CHECKPOINTS}, r AS (SELECT *, step % 1000 = 0 AS milestone, row_number() OVER (ORDER BY step DESC) <= 5 AS recent FROM ck) SELECT * FROM r WHERE milestone OR recent",
    "resume_point": f"WITH {CHECKPOINTS} SELECT * FROM ck ORDER BY step DESC LIMIT 1",
    "config_overlay": f"WITH {SETTINGS} SELECT a.key, coalesce(o.value, a.value) AS value FROM a LEFT JOIN o ON a.key = o.key",
    "config_diff": f"""WITH {SETTINGS}, j AS (SELECT coalesce(a.key, o.key) AS key, a.value AS left_value, o.value AS right_value FROM a FULL JOIN o ON a.key = o.key)
 SELECT *, string_split(key, '.')[2] IN ('use_ema', 'codebook_size') AS critical FROM j WHERE left_value IS DISTINCT FROM right_value""",
    "pos_embedding": f"""WITH {VECTORS}, p AS (SELECT vec_id, c, z[c + 1] AS v, pow(10000.0, -(c % 4) / 4.0::DOUBLE) * CASE WHEN c < 8 THEN vec_id // 6 % 4 ELSE vec_id % 6 END AS a FROM v, range(16) t(c))
 SELECT vec_id, c, round(v + CASE WHEN c // 4 % 2 = 0 THEN sin(a) ELSE cos(a) END, 6) AS value FROM p""",
    "quantizer_steps": f"""WITH {VECTORS}, q0 AS (SELECT code, unnest(range(0, 64)) AS dim, unnest(e) AS e, unnest(e) AS s, 1.0::DOUBLE AS n, 0::BIGINT AS u FROM cb), {trained(0)}, {trained(1)}
 SELECT code, round(any_value(n), 6) AS ema_n, any_value(u) AS usage, round(sum(e), 5) AS total, round(sum(s), 5) AS ema_total FROM q2 GROUP BY code""",
    "swish": f"WITH {VECTORS}, l AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(z) AS x FROM v) SELECT vec_id, i, round(x / (1 + exp(-x)), 6) AS value FROM l",
}
