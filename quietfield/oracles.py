"""The same queries in SQL, written apart from the DataFrame versions, for DuckDB."""

from __future__ import annotations

from . import constants as C
from .plans.simulate import ANIMALS, BENIGN, META_TYPES, MULTI


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def d(salt: str, n: int, key: str = "doc_id") -> str:
    return f"(CAST('0x' || substr(md5('{salt}:' || CAST({key} AS VARCHAR)), 1, 8) AS BIGINT) % {n})"


def pick(values: list[str], salt: str) -> str:
    return f"list_extract([{', '.join(map(q, values))}], {d(salt, len(values))} + 1)"


def num(salt: str, n: int) -> str:
    return f"CAST({d(salt, n)} + 1 AS VARCHAR)"


TITLE_ANIMAL = "CASE animal " + " ".join(f"WHEN {q(a)} THEN {q(a.title())}" for a in [*ANIMALS, "unknown"]) + " END"
RESERVE_TITLE = pick([r.title() for r in C.TAG_RESERVES], "cres")
TAG = f"""CASE WHEN {d('pat', 3)} = 0 THEN {pick(C.TAG_ZONE_WORDS, 'zw')} || {num('num', 9)} || '_' || {pick(C.TAG_RESERVES, 'res')}
  WHEN {d('pat', 3)} = 1 THEN 'outpost' || {num('gate', 6)} || '_' || {pick(C.TAG_RESERVES, 'res')}
  ELSE {num('dist', 9)} || {pick(C.TAG_UNITS, 'unit')} || '_near_waterhole' END"""
CAPTION = f"""CASE WHEN {d('ctpl', 3)} = 0 THEN 'At dawn a ' || animal || ' drank ' || {num('cdist', 9)} || ' ' || {pick(C.TAG_UNITS, 'cunit')} || ' from the ' || {RESERVE_TITLE} || ' salt lick'
  WHEN {d('ctpl', 3)} = 1 THEN {TITLE_ANIMAL} || ' tracks by ' || {RESERVE_TITLE} || ' compartment ' || {num('cbeat', 20)}
  ELSE 'Den of a ' || animal || ', ' || {num('cdist', 9)} || ' ' || {pick(C.TAG_UNITS, 'cunit')} || ' near the buffer zone of ' || {RESERVE_TITLE} END"""
CUTS = dict(C.CATEGORY_CUTS)
U = d("cat", 1000)
SPECIES = "species_table(species, sensitivity) AS (VALUES " + ", ".join(f"({q(k)}, {v}::DOUBLE)" for k, v in C.SPECIES_SENSITIVITY.items()) + ")"
ITEMS = f"""{SPECIES},
i0 AS (SELECT doc_id, doc_id + 1 AS serial, list_extract([{', '.join(map(q, ANIMALS))}], CAST(doc_id % {len(ANIMALS)} AS INT) + 1) AS animal FROM documents),
i1 AS (SELECT i0.*, coalesce(t.sensitivity, {C.UNKNOWN_SENSITIVITY}::DOUBLE) AS species_sensitivity FROM i0 LEFT JOIN species_table t ON replace(lower(trim(animal)), '_', ' ') = t.species),
i2 AS (SELECT *, CASE WHEN {U} < {CUTS['clean']} THEN 'clean' WHEN {U} < {CUTS['category_a']} THEN 'category_a' WHEN {U} < {CUTS['category_b']} THEN 'category_b'
  WHEN {U} < {CUTS['category_c']} THEN 'category_c' WHEN {U} < {CUTS['hard_negative_d']} THEN (CASE WHEN species_sensitivity >= {C.HIGH_SENSITIVITY}::DOUBLE THEN 'hard_negative_d' ELSE 'clean' END)
  WHEN {U} < {CUTS['category_e']} THEN 'category_e' ELSE 'multi' END AS feature_category,
  CASE WHEN {d('fmt', 1000)} < 120 THEN 'png' ELSE 'jpg' END AS ext FROM i1),
i3 AS (SELECT *, CASE WHEN feature_category = 'multi' THEN {pick(MULTI, 'multi')} WHEN feature_category LIKE 'category_%' THEN upper(substr(feature_category, 10, 1)) ELSE '' END AS parts FROM i2),
i4 AS (SELECT *, CASE feature_category WHEN 'clean' THEN 'clean' WHEN 'hard_negative_d' THEN 'species_sensitive_clean' WHEN 'category_a' THEN {pick(META_TYPES, 'meta')}
  WHEN 'category_b' THEN 'ocrtext' WHEN 'category_c' THEN {TAG} WHEN 'category_e' THEN 'steganography' ELSE 'multi_' || lower(parts) END AS feature_type FROM i3),
items AS (SELECT *, replace(animal, ' ', '_') || '_' || serial || '_' || feature_type || '.' || ext AS filename,
  CASE WHEN contains(parts, 'C') THEN {CAPTION} ELSE '' END AS caption,
  feature_category NOT IN ('clean', 'hard_negative_d') AS injected, CAST(feature_category NOT IN ('clean', 'hard_negative_d') AS INT) AS risk_label FROM i4)"""
SPLIT = f"""CASE WHEN rn <= round_even(n * {C.SPLIT_RATIOS['train']}::DOUBLE, 0) THEN 'train'
  WHEN rn <= round_even(n * {C.SPLIT_RATIOS['train']}::DOUBLE, 0) + round_even(n * {C.SPLIT_RATIOS['validate']}::DOUBLE, 0) THEN 'validate' ELSE 'test' END"""
MANIFEST = f"""{ITEMS},
ranked AS (SELECT *, count(*) OVER (PARTITION BY animal)::DOUBLE AS n, row_number() OVER (PARTITION BY animal ORDER BY md5(doc_id::VARCHAR), doc_id) AS rn FROM items),
split_rows AS (SELECT *, {SPLIT} AS split FROM ranked),
manifest AS (SELECT * EXCLUDE (n, rn), split || '_' || serial AS image_id FROM split_rows)"""


BLANK = r"[\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
EDGE = r"[^\p{L}\p{M}\p{N}_]"


def unicode(pattern: str) -> str:
    """A pattern whose digits, blanks and word bounds are those of all scripts; bounds stand only at its ends."""
    out = pattern.replace(r"\d", r"\p{Nd}").replace(r"\s", BLANK)
    begin, end = out.startswith(r"\b"), out.endswith(r"\b")
    return (f"(^|{EDGE})" if begin else "") + out[2 * begin : len(out) - 2 * end] + (f"($|{EDGE})" if end else "")


def any_of(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(w)})" for w in words) + ")"


def pts(flag: str, value: float) -> str:
    return f"CAST({flag} AS DOUBLE) * {value}::DOUBLE"


def rx(text: str, pattern: str, flags: str = "'i'") -> str:
    return f"regexp_matches({text}, {q(pattern)}, {flags})" if flags else f"regexp_matches({text}, {q(pattern)})"


def stem(name: str) -> str:
    return f"regexp_replace({name}, '^(\\.*[^.].*)\\.[^.]*$', '\\1')"


def filename_sql(name: str = "filename") -> dict[str, str]:
    s = stem(name)
    low = f"lower({s})"
    flat = f"replace(replace(replace({low}, ' ', ''), '_', ''), '-', '')"
    fragment, zone = any_of(low, C.RESERVE_FRAGMENTS), rx(low, C.ZONE_NUMBER, "")
    keyword = any_of(flat, [w.replace(" ", "") for w in C.LOCATION_KEYWORDS])
    distance, digits = rx(f"replace({s}, '_', ' ')", C.DISTANCE), rx(low, C.COORDINATE_DIGITS, "")
    score = f"(CASE WHEN {rx(s, C.GENERIC_NAME)} THEN 0.02::DOUBLE ELSE 0.12::DOUBLE END) + {pts(fragment, .45)} + {pts(zone, .3)} + {pts(keyword, .1)} + {pts(distance, .25)} + {pts(digits, .2)}"
    return {
        "filename_leak_score": f"least({score}, 1.0::DOUBLE)",
        "filename_has_location_keyword": f"({fragment} OR {zone} OR {keyword})",
        "filename_has_distance_pattern": distance,
        "filename_has_coordinate_pattern": digits,
    }


def caption_sql(text: str = "caption") -> dict[str, str]:
    low = f"lower({text})"
    fragment, distance = any_of(low, C.RESERVE_FRAGMENTS), rx(text, unicode(C.DISTANCE))
    hits = "(" + " + ".join(f"CAST(contains({low}, {q(w)}) AS INT)" for w in C.LOCATION_KEYWORDS) + ")"
    pair = rx(text, unicode(C.DECIMAL_PAIR), "")
    score = f"{pts(fragment, .4)} + {pts(distance, .35)} + least({hits} * 0.12::DOUBLE, 0.36::DOUBLE) + {pts(pair, .45)}"
    return {
        "caption_leak_score": f"least({score}, 1.0::DOUBLE)",
        "caption_has_location_keyword": f"({fragment} OR {hits} > 0)",
        "caption_has_distance_pattern": distance,
        "caption_has_coordinate_pattern": pair,
    }


def cols(parts: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in parts.items())


META = [*C.METADATA_SCORE_FLAGS, "has_datetime_original", "has_iptc_creator", "has_thumbnail", "description_contains_location", "keywords_contain_location"]
BUNDLE = f"""{ITEMS},
s0 AS (SELECT *, {cols({f: f"(contains(parts, 'A') AND {d(f, 2)} = 1)" for f in META})},
  (contains(parts, 'B') AND {d('ogps', 3)} = 0) AS ocr_gps_regex_match, (contains(parts, 'B') AND {d('ocam', 3)} = 0) AS ocr_camtrap_id_match,
  (contains(parts, 'B') AND {d('ozone', 3)} = 0) AS ocr_location_keyword_match,
  CASE WHEN contains(parts, 'E') AND {d('tr', 10)} < 7 THEN {d('trn', 2801)} + 200 ELSE 0 END AS trailing_byte_count,
  CASE WHEN contains(parts, 'E') THEN 0.2::DOUBLE ELSE ({d('lsb', 70)} + 10)::DOUBLE / 100.0::DOUBLE END AS lsb_variance_score,
  CASE WHEN ext = 'png' AND contains(parts, 'E') THEN {d('chunk', 3)} ELSE 0 END AS suspicious_png_chunk_count FROM items),
bundle AS (SELECT *, ocr_gps_regex_match::INT + ocr_camtrap_id_match::INT + ocr_location_keyword_match::INT AS n_hits,
  least(trailing_byte_count::DOUBLE / 5000.0::DOUBLE, 1.0::DOUBLE) AS trailing_byte_count_norm, animal AS species, {cols(filename_sql())}, {cols(caption_sql())} FROM s0)"""
SCORES = {
    "metadata": "(" + " + ".join(f"{f}::INT" for f in C.METADATA_SCORE_FLAGS) + ")::DOUBLE / 10.0::DOUBLE",
    "ocr": "CASE WHEN n_hits > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END",
    "context": "greatest(filename_leak_score, caption_leak_score)",
    "species": "species_sensitivity",
    "stego": "greatest(lsb_variance_score, least(trailing_byte_count_norm * 1.2::DOUBLE, 1.0::DOUBLE))",
}


def level(score: str, name: str) -> str:
    if name == "ocr":
        return "CASE WHEN n_hits > 0 THEN 'HIGH' ELSE 'NONE' END"
    h, m = C.LEVELS[name]
    return f"CASE WHEN {score} >= {h}::DOUBLE THEN 'HIGH' WHEN {score} >= {m}::DOUBLE THEN 'MEDIUM' WHEN {score} > 0 THEN 'LOW' ELSE 'NONE' END"


P = C.POLICY
SCORED = f"""{BUNDLE},
p0 AS (SELECT *, least(1.0::DOUBLE, 0.05::DOUBLE + 0.9::DOUBLE * greatest(filename_leak_score, caption_leak_score)) AS p,
  greatest({SCORES['metadata']}, {SCORES['ocr']}, {SCORES['context']}, {SCORES['stego']}) AS signal_score FROM bundle),
p1 AS (SELECT *, greatest(0.0::DOUBLE, least(100.0::DOUBLE, ({P['w_model']}::DOUBLE * p + {P['w_signal']}::DOUBLE * signal_score + {P['w_species']}::DOUBLE * species_sensitivity) * 100.0::DOUBLE)) AS blended_score FROM p0),
p2 AS (SELECT *, CASE WHEN blended_score >= {P['quarantine_min']} THEN 'QUARANTINE' WHEN blended_score > {P['review_max']} THEN 'SANITIZE' WHEN blended_score >= {P['safe_max']} THEN 'REVIEW' ELSE 'SAFE' END AS base_decision FROM p1),
p3 AS (SELECT *, (has_gps OR ocr_gps_regex_match OR ocr_camtrap_id_match) AND base_decision = 'SAFE' AS overridden FROM p2),
scored AS (SELECT *, CASE WHEN overridden THEN 'REVIEW' ELSE base_decision END AS decision,
  CASE WHEN overridden THEN greatest(blended_score, {P['safe_max']}::DOUBLE) ELSE blended_score END AS risk_score FROM p3)"""
UNPIVOT = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS category, {level(v, k)} AS level, round({v}, 6) AS score FROM scored" for k, v in SCORES.items())


def redact(text: str) -> str:
    out = f"regexp_replace({text}, {q(unicode(C.DISTANCE))}, '[REDACTED DISTANCE] ', 'gi')"
    for w in C.RESERVE_FRAGMENTS:
        out = f"regexp_replace({out}, {q(w)}, '[REDACTED LOCATION]', 'gi')"
    for w in C.LOCATION_KEYWORDS:
        out = f"regexp_replace({out}, {q(w)}, '[REDACTED]', 'gi')"
    return f"regexp_replace(regexp_replace({out}, {q('^' + BLANK + '+')}, ''), {q(BLANK + '+$')}, '')"


FACTORS = [
    ("has_gps", "'GPS_EXIF'"), ("has_gps_altitude OR has_gps_timestamp", "'GPS_DETAIL'"), ("has_camera_make OR has_camera_model", "'CAMERA'"),
    ("has_serial_number", "'SERIAL'"), ("has_owner_name", "'OWNER'"), ("description_contains_location OR keywords_contain_location", "'METADATA_WORDING'"),
    ("has_thumbnail", "'THUMBNAIL'"), ("filename_has_location_keyword", "'FILENAME_LOCATION'"), ("filename_has_distance_pattern", "'FILENAME_DISTANCE'"),
    ("caption_has_location_keyword OR caption_has_distance_pattern", "'CAPTION_LOCATION'"), ("trailing_byte_count > 0", "'TRAILING_BYTES:' || trailing_byte_count"),
    ("lsb_variance_score > 0.6::DOUBLE", "'LSB_PATTERN'"), ("suspicious_png_chunk_count > 0", "'ODD_CHUNKS'"), ("species_sensitivity >= 0.7::DOUBLE", "'SPECIES:' || species"),
]
TRUTH = "truth AS (SELECT l.doc_id, l.toxic AS y, d.n_chars, CAST(d.n_chars % 97 AS DOUBLE) / 96.0::DOUBLE AS score, CAST(d.n_chars % 97 >= 48 AS INT) AS pred FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"
CONFUSION = "conf AS (SELECT count(*) FILTER (WHERE y = 0 AND pred = 0) AS n00, count(*) FILTER (WHERE y = 0 AND pred = 1) AS n01, count(*) FILTER (WHERE y = 1 AND pred = 0) AS n10, count(*) FILTER (WHERE y = 1 AND pred = 1) AS n11 FROM truth)"


def ratio(a: str, b: str) -> str:
    return f"coalesce(({a})::DOUBLE / nullif({b}, 0)::DOUBLE, 0.0::DOUBLE)"


def report_row(name: str, tp: str, wrong: str, missed: str) -> str:
    return f"SELECT '{name}' AS class, {ratio(tp, f'{tp} + {wrong}')} AS precision, {ratio(tp, f'{tp} + {missed}')} AS recall, {ratio(f'2 * {tp}', f'2 * {tp} + {wrong} + {missed}')} AS f1, {tp} + {missed} AS support FROM conf"


TOKENS = f"""{ITEMS},
t0 AS (SELECT doc_id, 'img_' || doc_id AS image_id, unnest(range(0, {d('ntok', 3)} + 1)) AS k FROM items WHERE contains(parts, 'B')),
t1 AS (SELECT *, md5('tok:' || k || ':' || doc_id) AS h FROM t0),
t2 AS (SELECT *, list_extract([{', '.join(map(q, C.OCR_TOKENS))}], CAST('0x' || substr(h, 1, 6) AS BIGINT) % {len(C.OCR_TOKENS)} + 1) AS stamp,
  CAST('0x' || substr(h, 7, 6) AS BIGINT) % 300 AS x0, CAST('0x' || substr(h, 13, 6) AS BIGINT) % 200 AS y0, CAST('0x' || substr(h, 19, 6) AS BIGINT) % 100 AS c0 FROM t1),
t3 AS (SELECT *, unnest(string_split(stamp, ' ')) AS word, generate_subscripts(string_split(stamp, ' '), 1) - 1 AS j FROM t2),
t4 AS (SELECT *, unnest(range(0, 3)) AS psm_order FROM t3),
tokens AS (SELECT image_id, psm_order, k * 10 + j AS seq, CASE WHEN psm_order = 1 THEN lower(word) ELSE word END AS text,
  CASE WHEN c0 < 5 THEN -1.0::DOUBLE ELSE c0::DOUBLE END AS conf, x0 + j * 60 + (CASE WHEN psm_order = 2 THEN 9 ELSE psm_order END) AS x,
  y0 + (CASE WHEN psm_order = 2 THEN 9 ELSE psm_order END) AS y, length(word) * 9 AS w, 14 AS h FROM t4),
deduped AS (SELECT * FROM tokens QUALIFY row_number() OVER (PARTITION BY image_id, lower(text), x // 10, y // 10 ORDER BY psm_order, seq) = 1),
read_text AS (SELECT image_id, string_agg(text, ' ' ORDER BY psm_order, seq) AS raw_text, count(*) AS num_text_boxes,
  coalesce(avg(CASE WHEN conf >= 0 THEN conf END), 0.0::DOUBLE) AS mean_confidence FROM deduped GROUP BY image_id)"""
PLAIN = lambda w: f"lower(regexp_replace({w}, {q('^[.,' + chr(34) + chr(39) + ']+|[.,' + chr(34) + chr(39) + ']+$')}, '', 'g'))"
HITS = "hit_rows AS (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY l, k) - 1 AS ord, label, text FROM (" + " UNION ALL ".join(
    f"SELECT image_id, {n} AS l, '{name}' AS label, unnest(regexp_extract_all(raw_text, {q('(?i)' + p)})) AS text, generate_subscripts(regexp_extract_all(raw_text, {q('(?i)' + p)}), 1) AS k FROM read_text"
    for n, (name, p) in enumerate(C.OCR_LABELS)) + "))"
BOXES = f"""{TOKENS}, {HITS},
placed AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY psm_order, seq) AS i, {PLAIN('text')} AS plain FROM deduped),
aims AS (SELECT *, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS parts FROM hit_rows),
wanted AS (SELECT * EXCLUDE (parts), len(parts) AS size, array_to_string(list_transform(parts, lambda w: {PLAIN('w')}), '') AS target FROM aims),
runs AS (
  SELECT a.image_id, a.ord, s.i AS first, string_agg(t.plain, '' ORDER BY t.i) AS plain, min(t.x) AS x, min(t.y) AS y, max(t.x + t.w) AS r, max(t.y + t.h) AS b, count(*) AS n
  FROM wanted a JOIN placed s ON s.image_id = a.image_id JOIN placed t ON t.image_id = a.image_id AND t.i BETWEEN s.i AND s.i + a.size - 1 GROUP BY ALL),
fitting AS (SELECT runs.* FROM runs JOIN wanted USING (image_id, ord) WHERE n = size AND target <> '' AND (contains(plain, target) OR contains(target, plain))
  QUALIFY row_number() OVER (PARTITION BY image_id, ord ORDER BY first) = 1),
boxes AS (SELECT w.image_id, w.ord, w.label, w.text, coalesce(x, 0)::INT AS x, coalesce(y, 0)::INT AS y, coalesce(r - x, 0)::INT AS w, coalesce(b - y, 0)::INT AS h
  FROM wanted w LEFT JOIN fitting USING (image_id, ord))"""
FIELDS = ["gps", "altitude", "timestamp", "camera", "serial", "owner", "description", "keywords", "datetime", "thumbnail"]
BYTES = "bytes AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(floor((v::DOUBLE + 1.0::DOUBLE) * 128.0::DOUBLE) AS BIGINT)) AS v FROM embeddings)"
BITS = f"{BYTES}, bits AS (SELECT vec_id, generate_subscripts(v, 1) - 1 AS pos, unnest(v) & 1 AS bit FROM bytes)"
PLANE = f"""{BITS},
means AS (SELECT vec_id, avg(bit::DOUBLE) AS m FROM bits GROUP BY vec_id),
block_means AS (SELECT vec_id, pos // 8 AS b, avg(bit::DOUBLE) AS bm FROM bits GROUP BY vec_id, pos // 8),
plane AS (SELECT means.vec_id, any_value(m) AS m, var_pop(bm) AS bv FROM means JOIN block_means USING (vec_id) GROUP BY means.vec_id),
ent AS (SELECT *, (CASE WHEN m > 0 THEN -m * log2(m) ELSE 0.0 END) + (CASE WHEN 1.0::DOUBLE - m > 0 THEN -(1.0::DOUBLE - m) * log2(1.0::DOUBLE - m) ELSE 0.0 END) AS h FROM plane)"""
JPEG = """files AS (SELECT item_id, from_hex('FFD8FFE000040000FFDA0002') || encode(text) || from_hex('FFD9') AS content, encode('QUIETFIELD_V1:' || item_id) AS payload FROM benchmark),
put AS (SELECT *, content[1:2] || from_hex('FFFE') || from_hex(lpad(to_hex(octet_length(payload) + 2), 4, '0')) || payload || content[3:] AS marked FROM files)"""
CHAIN = """chain AS (SELECT item_id, sha256(text) AS h0, sha256('clean:' || text) AS h1 FROM benchmark),
rec AS (SELECT *, '{"algorithm": "SHA-256", "artifact_hash": "' || h1 || '", "artifact_id": "' || substr(h1, 1, 32) || '", "current_status": "sanitized", "operation": "sanitized", "parent_hash": "' || h0 || '", "previous_status": "unsafe", "timestamp": "2024-01-01T00:00:00+00:00", "version": 1}' AS record FROM chain)"""
DROPPED = "CASE WHEN item_id % 3 = 1 THEN replace(record, '\"parent_hash\": \"' || h0 || '\", ', '') WHEN item_id % 3 = 2 THEN replace(record, '\"version\"', '\"edition\"') ELSE record END"

SQL: dict[str, str] = {
    "analyse_decisions": f"WITH {SCORED} SELECT doc_id, filename, decision, round(risk_score, 6) AS risk_score, round(signal_score, 6) AS signal_score, round(p, 6) AS p FROM scored",
    "decision_counts": f"WITH {SCORED} SELECT decision, feature_category, count(*) AS n, round(avg(risk_score), 6) AS avg_risk FROM scored GROUP BY ALL",
    "filename_features": f"WITH {ITEMS} SELECT doc_id, filename, {cols({k: (f'round({v}, 6)' if 'score' in k else v) for k, v in filename_sql().items()})}, length({stem('filename')}) AS filename_length FROM items",
    "caption_features": f"WITH {ITEMS} SELECT doc_id, caption, {cols({k: (f'round({v}, 6)' if 'score' in k else v) for k, v in caption_sql().items()})} FROM items",
    "conversation_caption_scores": f"WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS caption FROM conversations) SELECT conv_id, turn, {cols({k: (f'round({v}, 6)' if 'score' in k else v) for k, v in caption_sql().items()})} FROM c",
    "page_filename_features": f"WITH f AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^.*/', '') AS filename FROM pages) SELECT page_id, {cols({k: (f'round({v}, 6)' if 'score' in k else v) for k, v in filename_sql().items()})} FROM f",
    "filename_entropy": f"WITH {ITEMS}, c AS (SELECT doc_id, unnest(string_split({stem('filename')}, '')) AS ch FROM items) SELECT doc_id, round(least(entropy(ch) / 4.5::DOUBLE, 1.0::DOUBLE), 6) AS filename_entropy_norm FROM c GROUP BY doc_id",
    "text_char_entropy": "WITH c AS (SELECT item_id, unnest(string_split(text, '')) AS ch FROM benchmark WHERE text <> '') SELECT item_id, round(entropy(ch), 6) AS entropy FROM c GROUP BY item_id",
    "names_species": f"WITH {ITEMS} SELECT doc_id, {any_of('lower(' + stem('filename') + ')', ANIMALS)} AS filename_has_species_keyword FROM items",
    "species_lookup_default": f"WITH {ITEMS} SELECT animal, any_value(species_sensitivity) AS species_sensitivity, count(*) AS n FROM items GROUP BY animal",
    "species_unknown_anti": f"WITH {ITEMS} SELECT doc_id, animal FROM items WHERE animal NOT IN (SELECT species FROM species_table)",
    "part_lookup_default": f"WITH {SPECIES} SELECT p_partkey, coalesce(sensitivity, {C.UNKNOWN_SENSITIVITY}::DOUBLE) AS sensitivity FROM part LEFT JOIN species_table ON replace(lower(trim(split_part(p_name, ' ', 1))), '_', ' ') = species",
    "keyword_hits_documents": "WITH t AS (SELECT doc_id, lower(text) AS t FROM documents) SELECT doc_id, " + " + ".join(f"contains(t, {q(w)})::INT" for w in C.LOCATION_KEYWORDS) + " AS keyword_hits FROM t WHERE t IS NOT NULL",
    "keyword_semi_join": "WITH kw(word) AS (VALUES " + ", ".join(f"({q(w)})" for w in C.LOCATION_KEYWORDS) + ") SELECT doc_id FROM documents WHERE EXISTS (SELECT 1 FROM kw WHERE contains(lower(text), word))",
    "keyword_document_frequency": "WITH kw(word) AS (VALUES " + ", ".join(f"({q(w)})" for w in C.LOCATION_KEYWORDS) + ") SELECT word, count(*) AS n_docs FROM kw JOIN documents ON contains(lower(text), word) GROUP BY word",
    "caption_redaction": f"WITH {ITEMS} SELECT doc_id, {redact('caption')} AS safe_caption FROM items",
    "document_redaction": f"SELECT doc_id, sha256({redact("coalesce(text, '')")}) AS safe_sha256 FROM documents",
    "category_verdicts_unpivot": f"WITH {SCORED} {UNPIVOT}",
    "category_level_counts": f"WITH {SCORED}, v AS ({UNPIVOT}) SELECT category, level, count(*) AS n, round(sum(score), 4) AS total FROM v GROUP BY ALL",
    "risk_score_components": f"WITH {SCORED} SELECT doc_id, {cols({k + '_score': f'round({v}, 6)' for k, v in SCORES.items()})}, round(blended_score, 6) AS blended_score FROM scored",
    "strong_evidence_override": f"WITH {SCORED} SELECT doc_id, base_decision, decision, round(blended_score, 6) AS blended_score, round(risk_score, 6) AS risk_score FROM scored WHERE overridden",
    "flagged_factors": f"WITH {SCORED} SELECT doc_id, array_to_string(list_filter([{', '.join(f'CASE WHEN {a} THEN {b} END' for a, b in FACTORS)}], lambda x: x IS NOT NULL), '|') AS factors FROM scored",
    "factor_counts": f"WITH {SCORED}, f AS (SELECT unnest(list_filter([{', '.join(f'CASE WHEN {a} THEN {b} END' for a, b in FACTORS)}], lambda x: x IS NOT NULL)) AS factor FROM scored) SELECT split_part(factor, ':', 1) AS factor, count(*) AS n FROM f GROUP BY 1",
    "stratified_split": f"WITH {MANIFEST} SELECT image_id, animal, split, feature_category, feature_type, risk_label FROM manifest",
    "split_counts": f"WITH {MANIFEST} SELECT split, count(*) AS n, sum(risk_label)::BIGINT AS n_pos FROM manifest GROUP BY split",
    "stratified_cap": f"""WITH {MANIFEST},
        tot AS (SELECT count(*)::DOUBLE AS t FROM manifest), cnt AS (SELECT split, feature_category, count(*)::DOUBLE AS c FROM manifest GROUP BY ALL),
        r AS (SELECT m.doc_id, m.split, m.feature_category, md5('cap:' || m.doc_id) AS dg, row_number() OVER (PARTITION BY m.split, m.feature_category ORDER BY md5('cap:' || m.doc_id), m.doc_id) AS rr FROM manifest m),
        k AS (SELECT r.* FROM r JOIN cnt USING (split, feature_category) CROSS JOIN tot WHERE rr <= greatest(1.0::DOUBLE, round_even(c * least(1.0::DOUBLE, 300.0::DOUBLE / t), 0)))
        SELECT doc_id, split, feature_category FROM (SELECT * FROM k ORDER BY dg, doc_id LIMIT 300)""",
    "manifest_rows": f"WITH {MANIFEST} SELECT image_id, animal, split, feature_category, feature_type, filename, injected, risk_label, species_sensitivity, caption FROM manifest",
    "species_stats": f"WITH {ITEMS}, p AS (SELECT animal, count(*) AS n FROM items GROUP BY animal) SELECT count(*) AS n_species, min(n) AS min_n, max(n) AS max_n, avg(n) AS avg_n, sum(n)::BIGINT AS total FROM p",
    "species_counts": f"WITH {ITEMS} SELECT animal, count(*) AS n, round(avg(species_sensitivity), 6) AS sensitivity FROM items GROUP BY animal",
    "category_distribution": f"WITH {ITEMS} SELECT feature_category, count(*) AS n FROM items GROUP BY feature_category",
    "draw_category": f"WITH {ITEMS} SELECT doc_id, animal, feature_category, ext FROM items",
    "leaky_caption_gen": f"WITH {ITEMS} SELECT doc_id, {CAPTION} AS caption FROM items",
    "benign_caption_gen": f"WITH {ITEMS} SELECT doc_id, CASE {d('btpl', 5)} {' '.join(f'WHEN {i} THEN {q(t)}' for i, t in enumerate(BENIGN))} ELSE 'A ' || animal || ', as it was' END AS caption FROM items",
    "leaky_filename_gen": f"""WITH {ITEMS} SELECT doc_id, {pick(C.TAG_RESERVES, 'fres')} || '_' || (CASE WHEN {d('fpat', 3)} = 0 THEN {pick(C.TAG_ZONE_WORDS, 'fzw')} || {num('fnum', 9)}
        WHEN {d('fpat', 3)} = 1 THEN 'grid' || {num('fgate', 6)} ELSE {num('fdist', 9)} || {pick(C.TAG_UNITS, 'funit')} || '_near_camp' END) || '_' || animal || '_' || serial || '.' || ext AS leaky,
        {pick(C.BENIGN_PREFIXES, 'bpre')} || '_' || ({d('bnum', 9000)} + 1000) || '_' || serial || '.' || ext AS benign FROM items""",
    "mixed_union": f"""WITH {MANIFEST}, m0 AS (SELECT doc_id, doc_id + 1 AS i, 'unknown' AS animal FROM documents),
        m1 AS (SELECT *, {TAG} AS tag, {CAPTION} AS caption FROM m0)
        SELECT image_id, animal, split, feature_category, feature_type, filename, caption, risk_label FROM manifest UNION ALL
        SELECT 'mixed_' || i, animal, 'mixed', 'mixed_all', 'all_' || tag, 'mixed_' || i || '_all_' || tag || '.jpg', caption, 1 FROM m1""",
    "global_serial": f"WITH {MANIFEST} SELECT image_id, row_number() OVER (ORDER BY split, md5(doc_id::VARCHAR), doc_id) AS global_serial FROM manifest",
    "confusion_matrix": f"WITH {TRUTH}, {CONFUSION} SELECT * FROM conf",
    "binary_metrics": f"WITH {TRUTH}, {CONFUSION} SELECT round({ratio('n00 + n11', 'n00 + n01 + n10 + n11')}, 9) AS accuracy, round({ratio('n11', 'n11 + n01')}, 9) AS precision, round({ratio('n11', 'n11 + n10')}, 9) AS recall, round({ratio('2 * n11', '2 * n11 + n01 + n10')}, 9) AS f1, n00 + n01 + n10 + n11 AS n FROM conf",
    "classification_report": f"""WITH {TRUTH}, {CONFUSION}, a AS ({report_row('0', 'n00', 'n10', 'n01')}), b AS ({report_row('1', 'n11', 'n01', 'n10')}), u AS (
        SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL
        SELECT 'macro avg', (a.precision + b.precision) / 2.0, (a.recall + b.recall) / 2.0, (a.f1 + b.f1) / 2.0, a.support + b.support FROM a, b UNION ALL
        SELECT 'weighted avg', (a.precision * a.support + b.precision * b.support) / (a.support + b.support), (a.recall * a.support + b.recall * b.support) / (a.support + b.support), (a.f1 * a.support + b.f1 * b.support) / (a.support + b.support), a.support + b.support FROM a, b)
        SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM u""",
    "roc_auc": f"WITH {TRUTH} SELECT (SELECT count(*) FROM truth WHERE y = 1) AS n_pos, (SELECT count(*) FROM truth WHERE y = 0) AS n_neg, round((SELECT sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END)::DOUBLE / count(*) FROM truth a, truth b WHERE a.y = 1 AND b.y = 0), 9) AS auc",
    "class_weight": f"WITH {ITEMS} SELECT sum(risk_label)::BIGINT AS n_pos, sum(1 - risk_label)::BIGINT AS n_neg, round(greatest(sum(1 - risk_label), 1)::DOUBLE / greatest(sum(risk_label), 1)::DOUBLE * {C.POSITIVE_WEIGHT_BOOST}::DOUBLE, 9) AS scale_pos_weight FROM items",
    "calibration_topk": f"WITH {SCORED} SELECT doc_id, round(risk_score, 6) AS risk_score FROM (SELECT * FROM scored ORDER BY round(risk_score, 6) DESC, doc_id LIMIT 10)",
    "sha256_text": "SELECT doc_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL",
    "hash_chain": "SELECT item_id, sha256(text) AS h0, sha256('clean:' || text) AS h1, sha256('clean:' || text || sha256(text) || sha256('clean:' || text)) AS h2 FROM benchmark",
    "jpeg_comment_roundtrip": f"WITH {JPEG} SELECT item_id, sha256(marked) AS marked, sha256(content) AS stripped, decode(payload) AS payload FROM put",
    "png_text_roundtrip": "SELECT item_id, 'note:' || item_id AS payload, true AS same FROM benchmark",
    "provenance_record_json": f"WITH {CHAIN} SELECT item_id, record, sha256(record) AS record_hash FROM rec",
    "required_fields_missing": f"WITH {CHAIN}, broken AS (SELECT item_id, {DROPPED} AS record FROM rec), need(f) AS (VALUES {', '.join(f'({q(f)})' for f in C.PROVENANCE_FIELDS)}) SELECT item_id, coalesce(string_agg(f, ',' ORDER BY f) FILTER (WHERE NOT list_contains(json_keys(record), f)), '') AS missing FROM broken, need GROUP BY item_id",
    "verify_status": "SELECT item_id, item_id % 4 <> 3 AS provenance_found, item_id % 4 = 0 AS valid, CASE item_id % 4 WHEN 0 THEN 'INTACT' WHEN 1 THEN 'HASH' WHEN 2 THEN 'PARENT' ELSE 'NOT_FOUND' END AS reasons FROM benchmark",
    "tamper_detection": "SELECT item_id, k AS format, CASE WHEN k = 'JPEG' THEN true WHEN how = 'tail' THEN false ELSE true END AS detected, how FROM benchmark, (VALUES ('JPEG', 'tail'), ('PNG', 'tail'), ('PNG', 'chunk')) AS t(k, how)",
    "ocr_token_dedupe": f"WITH {TOKENS} SELECT image_id, psm_order, seq, text, x, y FROM deduped",
    "ocr_mean_conf": f"WITH {TOKENS} SELECT image_id, num_text_boxes, round(mean_confidence, 6) AS mean_confidence, raw_text FROM read_text",
    "ocr_hits": f"WITH {TOKENS}, h AS (" + " UNION ALL ".join(f"SELECT image_id, '{name}' AS label, unnest(regexp_extract_all(raw_text, {q('(?i)' + p)})) AS text FROM read_text" for name, p in C.OCR_LABELS) + ") SELECT image_id, label, text, count(*) AS n FROM h GROUP BY ALL",
    "lsb_stats": f"WITH {BITS} SELECT vec_id, round(avg(bit::DOUBLE), 12) AS lsb_mean, round(var_pop(bit::DOUBLE), 12) AS lsb_variance FROM bits GROUP BY vec_id",
    "lsb_block_variance": f"WITH {PLANE} SELECT vec_id, round(bv, 12) AS block_variance FROM plane",
    "lsb_score": f"WITH {PLANE} SELECT vec_id, round(h, 9) AS lsb_entropy_norm, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.55::DOUBLE * abs(m - 0.5::DOUBLE) * 2.0::DOUBLE + 0.30::DOUBLE * least(abs(bv - 0.02::DOUBLE) * 10.0::DOUBLE, 1.0::DOUBLE) + 0.15::DOUBLE * h)), 9) AS lsb_variance_score FROM ent",
    "byte_entropy": f"WITH {BYTES}, u AS (SELECT vec_id, unnest(v) AS b FROM bytes) SELECT vec_id, round(entropy(b) / 8.0::DOUBLE, 6) AS byte_entropy FROM u GROUP BY vec_id",
    "gps_decimal": "SELECT doc_id, round((CASE WHEN doc_id % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) * ((doc_id % 90)::DOUBLE + (doc_id % 60)::DOUBLE / 60.0::DOUBLE + ((doc_id * 7) % 6000)::DOUBLE / 100.0::DOUBLE / 3600.0::DOUBLE), 9) AS latitude FROM documents",
    "safe_filename": "SELECT doc_id, 'sanitized_20240101_000000_' || substr(sha256(text), 1, 6) || '.jpg' AS safe_name FROM documents WHERE text IS NOT NULL",
    "allowed_files": f"WITH {ITEMS} SELECT doc_id, lower(list_extract(string_split(f, '.'), -1)) IN ('jpg', 'jpeg', 'png') AND contains(f, '.') AS allowed FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN filename WHEN 1 THEN upper(filename) WHEN 2 THEN filename || '.gif' ELSE replace(filename, '.', '') END AS f FROM items)",
    "event_json_keys": "WITH k AS (SELECT event_type, unnest(json_keys(props)) AS key FROM events WHERE props IS NOT NULL) SELECT event_type, key, count(*) AS n FROM k GROUP BY ALL",
    "analysis_view": f"WITH {SCORED} SELECT doc_id, decision, round(risk_score / 100.0::DOUBLE, 8) AS ring, {" || ',' || ".join(f"'{k}=' || {level(v, k)}" for k, v in SCORES.items())} AS grid, array_to_string(list_filter([{', '.join(f'CASE WHEN {a} THEN {b} END' for a, b in FACTORS)}], lambda x: x IS NOT NULL), '|') AS factors, decision IN ('SANITIZE', 'QUARANTINE') AS sanitize_now, decision = 'REVIEW' AS ask FROM scored",
    "ocr_bbox": f"WITH {BOXES} SELECT image_id, ord, label, text, [x, y, w, h] AS bbox FROM boxes",
    "ocr_redaction_boxes": f"WITH {BOXES} SELECT image_id, ord, greatest(0, x - 6) AS x0, greatest(0, y - 6) AS y0, least(640, x + w + 6) AS x1, least(480, y + h + 6) AS y1, greatest(10, least(w, h) // 2) AS radius FROM boxes WHERE w > 0 AND h > 0 AND least(640, x + w + 6) > greatest(0, x - 6) AND least(480, y + h + 6) > greatest(0, y - 6)",
    "exif_gps_decode": f"WITH {ITEMS} SELECT doc_id, true AS has_gps, round(12.0::DOUBLE + 58.0::DOUBLE / 60.0::DOUBLE + 17.76::DOUBLE / 3600.0::DOUBLE, 6) AS lat, round(77.0::DOUBLE + 35.0::DOUBLE / 60.0::DOUBLE + 40.56::DOUBLE / 3600.0::DOUBLE, 6) AS lon, 2 AS gps_field_count FROM items WHERE contains(parts, 'A')",
    "injected_fields": f"WITH c AS (SELECT doc_id, list_transform(list_slice(list_sort(list_transform([{', '.join(map(q, FIELDS))}], lambda n: md5('field:' || n || doc_id) || n)), 1, {d('nfields', 4)} + 1), lambda x: substr(x, 33)) AS f FROM documents) SELECT doc_id, "
    + ", ".join(f"list_contains(f, '{n}')" + (" AND list_contains(f, 'gps')" if n in ("altitude", "timestamp") else "") + f" AS {n}" for n in FIELDS) + " FROM c",
    "upload_limit": "SELECT count(*) FILTER (WHERE octet_length(encode(text)) <= 26214400) AS accepted, count(*) FILTER (WHERE octet_length(encode(text)) > 26214400) AS rejected FROM documents",
}
