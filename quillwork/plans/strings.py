"""String normalisation, classes and extraction (STR)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as fn
from ..functions.text import filled, nfc, squeeze
from ..operators.identity import record_id
from ..sources.web import urljoin
from .registry import Plan

plan = Plan()
q = plan.add
_WS = r"'[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}]+'"


def _key(c: str) -> str:
    return f"lower(trim(regexp_replace(nfc_normalize(coalesce({c}, '')), {_WS}, ' ', 'g')))"


_SPECIES, _FAMILY = _key("scientific_name"), f"regexp_replace({_key('family')}, '\\.+$', '')"


@q("str_01_squeeze", f"SELECT record_id, trim(regexp_replace(name, {_WS}, ' ', 'g')) AS name FROM names")
def str_01(t):
    return t.names.select("record_id", squeeze(F.col("name")).alias("name"))


@q("str_02_nfc", "SELECT record_id, nfc_normalize(name) AS name FROM names")
def str_02(t):
    return t.names.select("record_id", nfc(F.col("name")).alias("name"))


@q("str_03_name_key", f"SELECT plant_index, {_SPECIES} AS key FROM plant_index")
def str_03(t):
    return t.plant_index.select("plant_index", fn.species_key(F.col("scientific_name")).alias("key"))


@q("str_04_family_key", f"SELECT plant_index, {_FAMILY} AS key FROM plant_index")
def str_04(t):
    return t.plant_index.select("plant_index", fn.family_key(F.col("family")).alias("key"))


_BARE, _JOINED = r"regexp_replace(coalesce(scientific_name, ''), '^\s+|\s+$', '', 'g')", f"trim(regexp_replace(coalesce(scientific_name, ''), {_WS}, ' ', 'g'))"


@q("str_05_change_class", rf"SELECT plant_index, CASE WHEN b = k THEN 'none' WHEN lower(b) = k THEN 'case' WHEN j = k THEN 'white space' WHEN regexp_replace(lower(b), '\.+$', '') = k OR regexp_replace(lower(j), '\.+$', '') = k THEN 'punctuation' WHEN lower(j) = k THEN 'white space and case' ELSE 'other' END AS change FROM (SELECT plant_index, {_BARE} AS b, {_JOINED} AS j, {_SPECIES} AS k FROM plant_index)")
def str_05(t):
    return t.plant_index.select("plant_index", fn.change_class(F.col("scientific_name"), fn.species_key(F.col("scientific_name"))).alias("change"))


@q("str_06_reconciliation", f"WITH k AS (SELECT plant_index, scientific_name, {_SPECIES} AS k FROM plant_index) SELECT plant_index, count(*) OVER (PARTITION BY k) AS n_same_key, count(*) OVER (PARTITION BY k) > 1 AS review FROM k")
def str_06(t):
    k = t.plant_index.select("plant_index", fn.species_key(F.col("scientific_name")).alias("k"))
    c = k.groupBy("k").agg(F.count(F.lit(1)).alias("n_same_key"))
    return k.join(c, "k").select("plant_index", "n_same_key", (F.col("n_same_key") > 1).alias("review"))


@q("str_07_record_id", "SELECT plant_index, substring(sha256(coalesce(scientific_name, '') || chr(30) || coalesce(family, '') || chr(30) || coalesce(synonym, '') || chr(30) || coalesce(source_page_url, '')), 1, 16) AS record_id FROM plant_index")
def str_07(t):
    return t.plant_index.select("plant_index", record_id(F.col("scientific_name"), F.col("family"), F.col("synonym"), F.col("source_page_url")).alias("record_id"))


@q("str_08_clean_name", f"SELECT record_id, trim(regexp_replace(translate(name, '`´', ''''''), {_WS}, ' ', 'g')) AS name FROM names")
def str_08(t):
    return t.names.select("record_id", fn.clean(F.col("name")).alias("name"))


_WORDS = r"list_filter(string_split_regex({c}, '[\s\x{{00A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{3000}}]+'), lambda x: x <> '')"
_NAME = _WORDS.format(c="scientific_name")
_LEAD = _WORDS.format(c="split_part(scientific_name, '(', 1)")
_BARE_LEAD = _WORDS.format(c=r"split_part(regexp_replace(scientific_name, '^[.\s\x{00A0}]+', ''), '(', 1)")
_SHAPE = rf"""SELECT plant_index, CASE WHEN regexp_matches(scientific_name, '(?i)\bsubsp\b') THEN 'subspecies' WHEN regexp_matches(scientific_name, '(?i)\bvar\b') THEN 'variety'
  WHEN starts_with(coalesce(w[1], '.'), '.') OR regexp_matches(scientific_name, '\(\s*\)') THEN 'defect'
  WHEN contains(scientific_name, '(') AND contains(scientific_name, ')') THEN CASE WHEN len(h) = 2 THEN 'parenthetical author' ELSE 'defect' END
  WHEN regexp_matches(scientific_name, ' (ex|ex\.|et|&|sensu|non) ') OR len(w) > 3 THEN CASE WHEN len(w) >= 2 THEN 'several authors' ELSE 'defect' END
  WHEN len(w) = 3 THEN 'one author' WHEN len(w) = 2 THEN 'no author' ELSE 'defect' END AS shape,
  CASE WHEN len(b) >= 2 THEN b[1] || ' ' || b[2] END AS binomial
FROM (SELECT plant_index, scientific_name, {_NAME} AS w, {_LEAD} AS h, {_BARE_LEAD} AS b FROM plant_index WHERE scientific_name IS NOT NULL)"""


@q("str_09_name_shape", _SHAPE)
def str_09(t):
    return t.plant_index.filter("scientific_name IS NOT NULL").select("plant_index", fn.shape_class(F.col("scientific_name")).alias("shape"), fn.binomial(F.col("scientific_name")).alias("binomial"))


@q("str_11_short_query", f"""SELECT plant_index, CASE WHEN b THEN 'parenthetical author' WHEN len(w) = 3 THEN 'one author' WHEN len(w) > 3 THEN 'several authors' ELSE 'other' END AS pattern,
  CASE WHEN b THEN trim(split_part(scientific_name, '(', 1)) WHEN len(w) >= 3 THEN w[1] || ' ' || w[2] ELSE trim(scientific_name) END AS query
FROM (SELECT plant_index, scientific_name, {_NAME} AS w, contains(scientific_name, '(') AND contains(scientific_name, ')') AS b FROM plant_index WHERE scientific_name IS NOT NULL)""")
def str_11(t):
    return t.plant_index.filter("scientific_name IS NOT NULL").select("plant_index", fn.short_query(F.col("scientific_name")).alias("q")).select("plant_index", "q.pattern", "q.query")


@q("str_13_unmatched_class", r"SELECT record_id, CASE WHEN regexp_matches(name, '^\([^)]+\)-') THEN 'stereo prefix' WHEN contains(name, ', ') THEN 'inverted' WHEN regexp_matches(name, '\([A-Za-z0-9\s\-]{2,}\)|\[.+\]') THEN 'bracketed synonym' WHEN lower(name) LIKE '%s' OR regexp_matches(lower(name), 'derivatives|fraction|extract|glycosides|alkaloids|phenols|flavonoids|tannins|saponins') THEN 'class or plural' ELSE 'other' END AS kind FROM names WHERE name IS NOT NULL")
def str_13(t):
    return t.names.filter("name IS NOT NULL").select("record_id", fn.unmatched_class(F.col("name")).alias("kind"))


_DROP = ", ".join(f"'{w}'" for w in fn.STEREO_WORDS)


@q("str_14_stereo_free_key", rf"""SELECT record_id, regexp_replace(array_to_string(list_filter(string_split_regex(regexp_replace(lower(nfc_normalize(name)), '[?\x{{00B1}}+]', '', 'g'), '[^\p{{L}}\p{{M}}\p{{N}}_]+'), lambda w: NOT list_contains([{_DROP}], w) AND NOT regexp_matches(w, '^[0-9]+[a-z]?$')), ''), '[^a-z0-9]', '', 'g') AS key FROM names""")
def str_14(t):
    return t.names.select("record_id", fn.stereo_free(F.col("name")).alias("key"))


@q("str_16_bracket_aware_split", "WITH p AS (SELECT plant_index, list_filter(list_concat([trim(coalesce(synonym, '-') || ' (a, b [c, d])')], list_transform(string_split(coalesce(family, ''), ','), lambda x: trim(x))), lambda x: x <> '') AS l FROM plant_index WHERE NOT regexp_matches(coalesce(synonym, '-') || coalesce(family, ''), '[(（【\\[\\])）】]') AND NOT contains(coalesce(synonym, '-'), ',')) SELECT plant_index, unnest(range(len(l))) AS pos, unnest(l) AS term FROM p")
def str_16(t):
    """Lines with a bracketed tail of their own; names that hold brackets or commas themselves are tested against brute force."""
    line = F.concat(F.coalesce("synonym", F.lit("-")), F.lit(" (a, b [c, d]), "), F.coalesce("family", F.lit("")), F.lit(","))
    plain = ~F.concat(F.coalesce("synonym", F.lit("-")), F.coalesce("family", F.lit(""))).rlike(r"[(（【\[\])）】]") & ~F.coalesce("synonym", F.lit("-")).contains(",")
    return t.plant_index.filter(plain).select("plant_index", F.posexplode(fn.split_outside_brackets(line)).alias("pos", "term"))


@q("str_17_light_term", r'''SELECT plant_index, regexp_replace(regexp_replace(lower(family), '\s+', ' ', 'g'), '^[\s.,;:!?''"()\[\]{}\x{2013}\x{2014}-]+|[\s.,;:!?''"()\[\]{}\x{2013}\x{2014}-]+$', '', 'g') AS term FROM plant_index''')
def str_17(t):
    return t.plant_index.select("plant_index", fn.light_term(F.col("family")).alias("term"))


@q("str_18_id_extraction", "SELECT activity_id, loaded_at, activity_id::VARCHAR AS cid FROM activities WHERE activity_id IS NOT NULL")
def str_18(t):
    line = F.concat(F.lit("see (cid : "), F.col("activity_id").cast("string"), F.lit(") and CID: -"))
    return t.activities.filter("activity_id IS NOT NULL").select("activity_id", "loaded_at", fn.compound_id(line).alias("cid"))


@q("str_19_quality_flags", r"SELECT record_id, array_to_string(list_filter([CASE WHEN len(coalesce(cids, [])) < 1 THEN 'missing_id' END, CASE WHEN contains(name, '?') THEN 'uncertain_name' END, CASE WHEN length(trim(name)) < 4 THEN 'very_short_name' END, CASE WHEN regexp_matches(name, '-\s+') THEN 'spacing_anomaly' END], lambda x: x IS NOT NULL), ';') AS flags FROM names")
def str_19(t):
    return t.names.select("record_id", fn.quality_flags(F.col("name"), F.col("cids")).alias("flags"))


@q("str_20_header_to_field", "SELECT doc_id, source AS header, CASE WHEN regexp_matches(h, 'monograph|^plant') THEN 'plant' WHEN regexp_matches(h, 'compound') THEN 'compound' WHEN regexp_matches(h, 'assay|trial') THEN 'study' WHEN regexp_matches(h, 'label$|^field') THEN 'collection' END AS field FROM (SELECT doc_id, source, lower(trim(source)) AS h FROM documents WHERE source IS NOT NULL)")
def str_20(t):
    from ..sources.html import field_of

    rules = {"plant": "monograph|^plant", "compound": "compound", "study": "assay|trial", "collection": "label$|^field"}
    return t.documents.filter("source IS NOT NULL").select("doc_id", F.col("source").alias("header"), field_of(F.col("source"), rules).alias("field"))


@q("str_21_doi_url", "SELECT activity_id, loaded_at, '10.1234/j.' || doc_id AS doi, 'https://doi.example/10.1234/j.' || doc_id || '.' AS url FROM activities WHERE doc_id IS NOT NULL")
def str_21(t):
    line = F.concat(F.lit("cited as https://doi.example/10.1234/j."), F.col("doc_id").cast("string"), F.lit(". here"))
    return t.activities.filter("doc_id IS NOT NULL").select("activity_id", "loaded_at", fn.doi(line).alias("doi"), fn.url(line).alias("url"))


@q("str_22_reference_status", "SELECT plant_index, CASE WHEN source_page_url IS NULL OR trim(source_page_url) IN ('', '-') THEN 'unreferenced' WHEN regexp_matches(source_page_url, 'https?://') THEN 'linked' ELSE 'described' END AS status FROM plant_index")
def str_22(t):
    r = F.col("source_page_url")
    return t.plant_index.select("plant_index", F.when(r.isNull() | F.trim(r).isin("", "-"), "unreferenced").when(fn.url(r).isNotNull(), "linked").otherwise("described").alias("status"))


@q("str_23_search_url", "SELECT p_partkey, 'https://x.example/find?q=' || replace(p_name, ' ', '+') AS url, 'https://x.example/part/' || p_partkey AS detail FROM part")
def str_23(t):
    return t.part.select("p_partkey", F.concat(F.lit("https://x.example/find?q="), F.url_encode("p_name")).alias("url"), urljoin(F.lit("https://x.example/list/all"), F.concat(F.lit("../part/"), F.col("p_partkey").cast("string"))).alias("detail"))


@q("str_24_spaceless_match", "SELECT c_custkey FROM customer WHERE replace(lower(c_mktsegment), ' ', '') = 'building'")
def str_24(t):
    return t.customer.filter(F.replace(F.lower("c_mktsegment"), F.lit(" "), F.lit("")) == "building").select("c_custkey")


@q("str_25_keyword_any", "SELECT doc_id, regexp_matches(lower(text), 'pain|ache|swelling|inflam') AS flag FROM documents WHERE text IS NOT NULL")
def str_25(t):
    return t.documents.filter("text IS NOT NULL").select("doc_id", F.lower("text").rlike("pain|ache|swelling|inflam").alias("flag"))


_PHRASES = ("hydrophilic", "antioxidant", "toxic")


@q("str_26_phrase_context", f"WITH d AS (SELECT doc_id, lower(text) AS t, phrase FROM documents, (VALUES {', '.join(f'({p!r})' for p in _PHRASES)}) v(phrase) WHERE contains(lower(text), phrase)), p AS (SELECT doc_id, t, phrase, unnest(range(1, length(t) + 1)) AS i FROM d) SELECT doc_id, phrase, substring(t, greatest(1, i - 40), i - greatest(1, i - 40)) AS before, substring(t, i + length(phrase), 40) AS after, count(*) AS n FROM p WHERE substring(t, i, length(phrase)) = phrase GROUP BY ALL")
def str_26(t):
    hits = fn.phrase_contexts(t.documents.select("doc_id", F.lower("text").alias("t")), "t", _PHRASES)
    return hits.groupBy("doc_id", "phrase", "before", "after").agg(F.count(F.lit(1)).alias("n"))


@q("str_27_formula_class", r"SELECT molregno, CASE WHEN molecular_formula IS NULL OR NOT regexp_matches(molecular_formula, '[\p{L}\p{N}]') THEN 'missing' WHEN regexp_matches(molecular_formula, 'Cl|Br|F|I') THEN 'halogen' WHEN contains(molecular_formula, 'N') THEN 'nitrogen' ELSE 'plain' END AS kind FROM compound_structures")
def str_27(t):
    f = F.col("molecular_formula")
    return t.compound_structures.select("molregno", F.when(~filled(f), "missing").when(f.rlike("Cl|Br|F|I"), "halogen").when(f.contains("N"), "nitrogen").otherwise("plain").alias("kind"))


@q("str_29_analysis_units", f"SELECT 'AU_' || lpad(min(plant_index)::VARCHAR, 4, '0') AS unit, count(*) AS n_plants FROM (SELECT plant_index, {_SPECIES} AS k FROM plant_index) GROUP BY k")
def str_29(t):
    k = t.plant_index.select("plant_index", fn.species_key(F.col("scientific_name")).alias("k"))
    return k.groupBy("k").agg(F.concat(F.lit("AU_"), F.lpad(F.min("plant_index").cast("string"), 4, "0")).alias("unit"), F.count(F.lit(1)).alias("n_plants")).drop("k")


@q("str_30_keyword_slug", r"SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def str_30(t):
    return t.part.select("p_partkey", F.regexp_replace(F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "-"), "^-+|-+$", "").alias("slug"))


_REST = lambda r: rf"regexp_extract(scientific_name, '(?i)^\s*(.*?)\s*\b{r}\b\.?\s*([A-Za-z]+)', ['a', 'b'])"


@q("str_10_resolver", rf"""WITH b AS (SELECT plant_index, scientific_name, family, {_NAME} AS w, {_LEAD} AS h, {_REST("subsp")} AS s, {_REST("var")} AS v,
    contains(scientific_name, '(') AND contains(scientific_name, ')') AS br, regexp_matches(scientific_name, ' (ex|ex\.|&|et|sensu|non) ') OR regexp_matches(scientific_name, '(?i)\b(Hook\.|Burm\.|L\.|Forst\.|Schult\.|Hallier)\s+f\.') AS j FROM plant_index WHERE scientific_name IS NOT NULL),
  c AS (SELECT *, {_WORDS.format(c="v.a")} AS vw FROM b),
  r AS (SELECT plant_index, family, CASE WHEN s.b <> '' THEN struct_pack(p := 'subspecies', q := trim(split_part(s.a, '(', 1)) || ' subsp. ' || s.b)
    WHEN v.b <> '' THEN struct_pack(p := 'variety', q := CASE WHEN len(vw) >= 2 THEN vw[1] || ' ' || vw[2] ELSE v.a END || ' var. ' || v.b)
    WHEN br AND len(h) = 2 THEN struct_pack(p := 'parenthetical author', q := h[1] || ' ' || h[2])
    WHEN (j OR len(w) > 3) AND len(w) >= 2 THEN struct_pack(p := 'several authors', q := w[1] || ' ' || w[2])
    WHEN len(w) = 3 THEN struct_pack(p := 'one author', q := w[1] || ' ' || w[2]) ELSE struct_pack(p := 'review', q := trim(scientific_name)) END AS x FROM c)
SELECT plant_index, CASE WHEN family IS NULL THEN 'review' ELSE x.p END AS pattern, CASE WHEN family IS NULL THEN 'checked by hand' ELSE x.q END AS query, family IS NULL AS from_override, CASE WHEN family IS NULL OR x.p = 'review' THEN 'manual review' ELSE 'ready' END AS status FROM r""")
def str_10(t):
    from ..operators.joins import override

    p = t.plant_index.filter("scientific_name IS NOT NULL").select("plant_index", "family", fn.query_name(F.col("scientific_name")).alias("r"))
    by_hand = p.filter("family IS NULL").select("plant_index", F.lit("checked by hand").alias("query"))  # stands for a table of corrections
    out = override(p, by_hand, "plant_index", F.col("r.query"), "query")
    pattern = F.when(F.col("from_override"), "review").otherwise(F.col("r.pattern"))
    return out.select("plant_index", pattern.alias("pattern"), "query", "from_override", F.when(pattern == "review", "manual review").otherwise("ready").alias("status"))


@q("str_12_two_variants", "WITH n AS (SELECT record_id, name, status >= 500 AS failed, CASE WHEN len(coalesce(cids, [])) > 0 THEN 1 ELSE 0 END AS hit FROM names WHERE name IS NOT NULL), r AS (SELECT name, CASE WHEN bool_or(coalesce(failed, false)) THEN NULL ELSE sum(hit)::BIGINT END AS n_raw FROM n GROUP BY 1), k AS (SELECT lower(trim(name)) AS k, sum(hit)::BIGINT AS n_clean FROM n GROUP BY 1) SELECT r.name, CASE WHEN n_raw > 0 THEN 'raw matched' WHEN n_raw = 0 AND n_clean > 0 THEN 'improved' WHEN n_raw = 0 AND n_clean = 0 THEN 'both empty' ELSE 'needs review' END AS decision FROM r JOIN k ON k.k = lower(trim(r.name))")
def str_12(t):
    """Rows found under a name as it is written against rows found under its plain form; a failed look-up has no count."""
    n = t.names.filter("name IS NOT NULL").select("name", F.coalesce(F.col("status") >= 500, F.lit(False)).alias("failed"), F.when(F.coalesce(F.size("cids"), F.lit(0)) > 0, 1).otherwise(0).alias("hit"))
    r = n.groupBy("name").agg(F.when(~F.bool_or("failed"), F.sum("hit")).alias("n_raw"))
    k = n.groupBy(F.lower(F.trim("name")).alias("k")).agg(F.sum("hit").alias("n_clean"))
    return r.join(k, F.col("k") == F.lower(F.trim("name"))).select("name", fn.variant_decision(F.col("n_raw"), F.col("n_clean")).alias("decision"))


_LAYER = r"substring(regexp_replace(upper(trim(standard_inchi_key)), '^INCHIKEY=', ''), 1, 14)"


@q("str_28_tier_cascade", rf"""WITH l AS (SELECT inchikey_connectivity AS layer, trim(n) AS name, lower(trim(n)) AS k FROM (SELECT inchikey_connectivity, unnest(string_split(compound_names, '|')) AS n FROM compounds_unique) WHERE trim(n) <> ''),
  s AS (SELECT DISTINCT lower(trim(pref_name)) AS k, {_LAYER} AS layer FROM compound_structures WHERE regexp_matches(pref_name, '[\p{{L}}\p{{N}}]') AND regexp_matches(standard_inchi_key, '[\p{{L}}\p{{N}}]')),
  e AS (SELECT k, min(layer) AS lo, max(layer) AS hi FROM s GROUP BY 1), f AS (SELECT lower(trim(name)) AS k, count(DISTINCT id) AS n FROM (SELECT name, unnest(cids) AS id FROM names WHERE name IS NOT NULL) GROUP BY 1),
  r AS (SELECT l.layer, l.name, CASE WHEN s.k IS NOT NULL THEN 'synonym match' WHEN coalesce(f.n, 0) = 0 THEN 'name not found' WHEN e.k IS NOT NULL AND e.lo = e.hi AND e.lo = l.layer THEN 'same connectivity' WHEN e.k IS NOT NULL THEN 'other connectivity' WHEN f.n = 1 THEN 'one record' ELSE 'several records' END AS reason
    FROM l LEFT JOIN s ON s.k = l.k AND s.layer = l.layer LEFT JOIN e ON e.k = l.k LEFT JOIN f ON f.k = l.k)
SELECT layer, name, CASE WHEN reason IN ('synonym match', 'same connectivity', 'one record') THEN 'high' WHEN reason = 'other connectivity' THEN 'low' ELSE 'medium' END AS tier, reason FROM r""")
def str_28(t):
    """How far a compound's name agrees with its structure: by a synonym of that layer, else by what the look-up of the name finds."""
    key = lambda c: F.lower(F.trim(c))
    links = t.compounds_unique.select(F.col("inchikey_connectivity").alias("layer"), F.explode(F.split("compound_names", r"\|")).alias("n")).filter("trim(n) <> ''").select("layer", F.trim("n").alias("name"), key("n").alias("k"))
    own = F.substring(F.regexp_replace(F.upper(F.trim("standard_inchi_key")), "^INCHIKEY=", ""), 1, 14)
    known = t.compound_structures.filter(filled(F.col("pref_name")) & filled(F.col("standard_inchi_key"))).select(key("pref_name").alias("k"), own.alias("layer")).distinct()
    layers = known.groupBy("k").agg(F.min("layer").alias("lo"), F.max("layer").alias("hi"))
    found = t.names.filter("name IS NOT NULL").select(key("name").alias("k"), F.explode("cids").alias("id")).groupBy("k").agg(F.countDistinct("id").alias("n"))
    return fn.link_tiers(links, known, layers, found)


@q("str_31_page_flags", r"SELECT plant_index, array_to_string(list_filter([CASE WHEN NOT regexp_matches(coalesce(family, ''), '[\p{L}\p{N}]') THEN 'empty_family' END, CASE WHEN NOT regexp_matches(coalesce(synonym, ''), '[\p{L}\p{N}]') THEN 'empty_synonym' END, CASE WHEN contains(scientific_name, '?') OR contains(scientific_name, chr(65533)) THEN 'encoding' END], lambda x: x IS NOT NULL), ';') AS flags FROM plant_index")
def str_31(t):
    s = F.col("scientific_name")
    flags = F.array(F.when(~filled(F.col("family")), "empty_family"), F.when(~filled(F.col("synonym")), "empty_synonym"), F.when(s.contains("?") | s.contains("\ufffd"), "encoding"))
    return t.plant_index.select("plant_index", F.array_join(F.array_compact(flags), ";").alias("flags"))


@q("str_15_name_group")
def str_15(t):
    """Names of a genus: variants of one another, or several."""
    from ..operators.variants import variant_groups

    key = fn.species_key(F.col("scientific_name"))
    return variant_groups(t.plant_index.filter(filled(F.col("scientific_name"))).select(F.substring_index(key, " ", 1).alias("genus"), key.alias("n")), "genus", "n")


QUERIES, SQL = plan.queries, plan.sql
