"""Queries of identifier reconciliation, files, de-identification and strings."""

from pyspark.sql import functions as F

from cohortlake.functions import text as S
from cohortlake.operators import deid as E
from cohortlake.operators import files as P
from cohortlake.operators import idsets as R
from cohortlake.plans import data as D
from cohortlake.plans.base import query, table

_REP = "rep AS (SELECT set_name, id, count(*) AS n FROM ids WHERE id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1)"


@query("id_repetitions", f"WITH {D.IDS}, {_REP} SELECT set_name, id, n FROM rep")
def q_rep(spark, sf):
    return R.id_repetitions(D.ids(spark, sf))


@query("id_totals", f'WITH {D.IDS} SELECT set_name, count(*) AS total, (count(DISTINCT id) + max((id IS NULL)::INT))::BIGINT AS "unique" FROM ids GROUP BY 1')
def q_totals(spark, sf):
    return R.id_totals(D.ids(spark, sf))


@query("repeated_id_references", f"WITH {D.IDS}, {_REP} SELECT set_name, id, ref FROM ids SEMI JOIN rep USING (set_name, id)")
def q_refs(spark, sf):
    return R.repeated_id_references(D.ids(spark, sf))


@query("missing_id_references", f"WITH {D.IDS} SELECT set_name, ref FROM ids WHERE id IS NULL")
def q_missing(spark, sf):
    return R.missing_id_references(D.ids(spark, sf))


_ONLY = "fst AS (SELECT set_name, id, arg_min(ref, pos) AS ref FROM ids GROUP BY 1, 2), only_ AS (SELECT a.set_name AS set_a, n.set_name AS set_b, a.id, coalesce(a.ref, 'Not found') AS ref FROM fst a, (SELECT DISTINCT set_name FROM ids) n WHERE a.set_name <> n.set_name AND NOT EXISTS (SELECT 1 FROM fst b WHERE b.set_name = n.set_name AND b.id IS NOT DISTINCT FROM a.id))"


@query("compare_all", f"WITH {D.IDS}, {_ONLY} SELECT * FROM only_")
def q_compare(spark, sf):
    return R.compare_all(D.ids(spark, sf))


_TWO = D.IDS.replace("o_orderpriority AS set_name", "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'fast' ELSE 'slow' END AS set_name")


def _two(spark, sf):
    """All orders in two sets: the two highest priorities, and the others."""
    return D.ids(spark, sf).withColumn("set_name", F.when(F.col("set_name").isin("1-URGENT", "2-HIGH"), "fast").otherwise("slow"))


@query("compare_idsets", f"WITH {_TWO}, {_ONLY} SELECT * FROM only_")
def q_compare2(spark, sf):
    return R.compare_idsets(_two(spark, sf), "fast", "slow")


@query("foreign_repetitions", f"WITH {_TWO}, {_REP} SELECT ids.id, ref, n FROM ids JOIN rep ON rep.id = ids.id AND rep.set_name = 'slow' WHERE ids.set_name = 'fast'")
def q_foreign(spark, sf):
    return R.foreign_repetitions(_two(spark, sf), "fast", "slow")


@query("id_report", f"""WITH {D.IDS}, {_REP}
SELECT set_name, 'total' AS section, NULL::VARCHAR AS id, NULL::VARCHAR AS ref, count(*) AS n FROM ids GROUP BY 1
UNION ALL SELECT set_name, 'unique', NULL, NULL, count(DISTINCT id) + max((id IS NULL)::INT) FROM ids GROUP BY 1
UNION ALL SELECT set_name, 'repetition', id, NULL, n FROM rep
UNION ALL SELECT set_name, 'repeated reference', id, ref, NULL FROM ids SEMI JOIN rep USING (set_name, id)
UNION ALL SELECT set_name, 'missing reference', NULL, ref, NULL FROM ids WHERE id IS NULL""")
def q_report(spark, sf):
    return R.id_report(D.ids(spark, sf))


def _headers(spark, sf):
    o = table(spark, sf, "orders")
    return o.select((F.col("o_custkey") % 50).cast("string").alias("folder"), F.concat(F.lit("ID"), (F.col("o_custkey") % 50 + F.col("o_orderkey") % 2 * (F.col("o_custkey") % 3)).cast("string")).alias("id"))


_HEAD = "hd AS (SELECT (o_custkey % 50)::VARCHAR AS folder, 'ID' || (o_custkey % 50 + o_orderkey % 2 * (o_custkey % 3)) AS id FROM orders), per AS (SELECT folder, list_sort(list(DISTINCT id)) AS ids FROM hd GROUP BY 1)"


@query("patient_ids_per_folder", f"WITH {_HEAD} SELECT folder, ids FROM per")
def q_patients(spark, sf):
    return R.patient_ids_per_folder(_headers(spark, sf))


@query("reconcile_subject_id", f"WITH {_HEAD} SELECT folder, CASE WHEN len(ids) = 1 THEN ids[1] WHEN list_contains(ids, 'ID' || folder) THEN 'ID' || folder ELSE 'None' END AS subject_id FROM per")
def q_reconcile(spark, sf):
    f = R.patient_ids_per_folder(_headers(spark, sf)).withColumn("folder_id", F.concat(F.lit("ID"), F.col("folder")))
    return R.reconcile_subject_id(f).select("folder", "subject_id")


@query("folder_id", "SELECT c_custkey, CASE WHEN length(regexp_extract(c_name, '[1-9][0-9]*$')) > 3 THEN regexp_extract(c_name, '[1-9][0-9]*$') END AS folder_id FROM customer")
def q_folder(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", R.folder_id("c_name", "[1-9][0-9]*$").alias("folder_id"))


# files

_EXT = "regexp_extract(path, '(\\.nii\\.gz|\\.[^./]*)$', 1)"


@query("get_extension", f"WITH {D.FILES} SELECT path, {_EXT} AS ext FROM files")
def q_ext(spark, sf):
    return D.files(spark, sf).select("path", S.get_extension("path").alias("ext"))


@query("remove_ext", f"WITH {D.FILES} SELECT path, regexp_replace(path, '(\\.nii\\.gz|\\.[^./]*)$', '') AS bare FROM files")
def q_bare(spark, sf):
    return D.files(spark, sf).select("path", S.remove_ext("path").alias("bare"))


@query("add_extension_if_needed", f"WITH {D.FILES} SELECT path, CASE WHEN contains(path, '.html') THEN path ELSE path || '.html' END AS full_path FROM files")
def q_addext(spark, sf):
    return D.files(spark, sf).select("path", S.add_extension_if_needed("path", ".html").alias("full_path"))


@query("join_path", f"WITH {D.FILES} SELECT 'data/' || path AS joined FROM files")
def q_join(spark, sf):
    return D.files(spark, sf).select(S.join_path(F.lit("data"), "path").alias("joined"))


@query("common_prefix", f"WITH {D.FILES}, p AS (SELECT regexp_replace(path, '^[^/]*/', '') AS path, split_part(path, '/', 1) AS host FROM files), m AS (SELECT host, min(path) AS a, max(path) AS b FROM p GROUP BY 1), s AS (SELECT *, string_split(a, '/') AS x, string_split(b, '/') AS y FROM m), d AS (SELECT *, coalesce(list_position(list_transform(range(1, greatest(len(x), len(y)) + 1), lambda i: x[i] IS NOT DISTINCT FROM y[i]), false), len(x)) - 1 AS n FROM s) SELECT host, array_to_string(x[1:n], '/') AS prefix FROM d")
def q_prefix(spark, sf):
    p = D.files(spark, sf).select(F.regexp_replace("path", "^[^/]*/", "").alias("path"), F.split("path", "/")[0].alias("host"))
    return P.common_prefix(p, "host")


@query("prefix_items", f"WITH {D.FILES} SELECT path, list_transform(string_split(path, '/'), lambda x: 'p_' || x) AS items FROM files")
def q_items(spark, sf):
    return D.files(spark, sf).select("path", S.prefix_items(F.split("path", "/"), "p_").alias("items"))


@query("prefix_keys", "SELECT c_custkey, 'h_' || c_mktsegment AS key, c_acctbal AS value FROM customer")
def q_keys(spark, sf):
    m = F.create_map("c_mktsegment", "c_acctbal")
    return table(spark, sf, "customer").select("c_custkey", F.explode(S.prefix_keys(m, "h_")).alias("key", "value"))


@query("result_name", "SELECT p_partkey, p_name || CASE WHEN p_size % 2 = 0 THEN '' ELSE '_' || p_brand || '_' || p_size END || '_' || p_type || '_svm' AS name FROM part")
def q_name(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", S.result_name("p_name", F.lit("svm"), F.when(F.col("p_size") % 2 != 0, F.col("p_brand")), "p_size", "p_type").alias("name"))


@query("search_list", f"WITH {D.FILES} SELECT path FROM files WHERE regexp_matches(path, 'blog.*[0-9]{{3}}')")
def q_search(spark, sf):
    return S.search_list(D.files(spark, sf), "path", "blog.*[0-9]{3}")


@query("match_list", f"WITH {D.FILES} SELECT path, regexp_extract(path, '^(?:([a-z]+)\\.th)', 1) AS host FROM files WHERE regexp_matches(path, '^(?:([a-z]+)\\.th)')")
def q_match(spark, sf):
    return S.match_list(D.files(spark, sf), "path", "([a-z]+)\\.th", 1, "host")


@query("filter_names", f"WITH {D.FILES} SELECT path FROM files WHERE path SIMILAR TO '.*\\.example\\..*/en/.*'")
def q_names(spark, sf):
    return S.filter_names(D.files(spark, sf), "path", "*.example.*/en/*")


@query("filter_eq", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def q_eq(spark, sf):
    return S.filter_eq(table(spark, sf, "customer"), "c_mktsegment", "BUILDING").select("c_custkey")


@query("drop_hidden", f"WITH {D.FILES} SELECT path FROM (SELECT CASE WHEN contains(path, 'blog') THEN '.' ELSE '' END || path AS path FROM files) WHERE NOT starts_with(path, '.')")
def q_hidden(spark, sf):
    f = D.files(spark, sf).select(F.concat(F.when(F.contains("path", F.lit("blog")), ".").otherwise(""), "path").alias("path"))
    return S.drop_hidden(f, "path")


@query("filter_by", "SELECT p_name FROM (SELECT DISTINCT p_name FROM part) WHERE length(p_name) % 2 = 0")
def q_by(spark, sf):
    return S.filter_by(table(spark, sf, "part").select("p_name").distinct(), "p_name", lambda s: len(s) % 2 == 0)


_BASE = "regexp_extract(path, '[^/]*$')"


@query("find_files", f"WITH {D.FILES} SELECT path FROM files WHERE regexp_matches({_BASE}, '\\.html$')")
def q_find(spark, sf):
    return P.find_files(D.files(spark, sf), "\\.html$")


@query("complete_sets", f"WITH {D.FILES}, pat AS (SELECT unnest(['^1', '5', '[02468]$']) AS pattern), hit AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS dir, path FROM files, pat WHERE regexp_matches({_BASE}, pattern)) SELECT dir, count(*) AS n, list_sort(list(path)) AS files FROM hit GROUP BY 1 HAVING count(*) = 3")
def q_complete(spark, sf):
    pat = spark.createDataFrame([("^1",), ("5",), ("[02468]$",)], "pattern string")
    return P.complete_sets(D.files(spark, sf), pat)


@query("nearest_match", f"""WITH {D.FILES}, b AS (SELECT path FROM files), hit AS (SELECT path AS h FROM files WHERE regexp_matches({_BASE}, '^(?:[0-9]+\\.html)')),
 anc AS (SELECT path, l.level, array_to_string(string_split(path, '/')[1:len(string_split(path, '/')) - 1 - l.level], '/') AS dir FROM b, (SELECT unnest([0, 1, 2]) AS level) l),
 m AS (SELECT path, level, min(h) AS h FROM anc JOIN hit ON dir <> '' AND starts_with(h, dir || '/') GROUP BY 1, 2)
SELECT b.path, coalesce(arg_min(h, level), '') AS match FROM b LEFT JOIN m USING (path) GROUP BY 1""")
def q_nearest(spark, sf):
    f = D.files(spark, sf)
    return P.nearest_match(f, f, "[0-9]+\\.html")


_TREE = "tree AS (SELECT * FROM (VALUES ('en/blog', 1, '^blog'), ('en/blog', 2, '^en$'), ('fr/any', 2, '^fr$'), ('html', 3, 'html$')) t(node, level, pattern)), depth AS (SELECT node, count(*) AS d FROM tree GROUP BY 1), part_ AS (SELECT path, generate_subscripts(string_split(path, '/'), 1) AS level, unnest(string_split(path, '/')) AS part FROM files), cls AS (SELECT path, node FROM (SELECT path, node, count(*) AS n FROM part_ JOIN tree USING (level) WHERE regexp_matches(part, pattern) GROUP BY 1, 2) JOIN depth USING (node) WHERE n = d)"


def _classified(spark, sf):
    tree = spark.createDataFrame([("en/blog", 1, "^blog"), ("en/blog", 2, "^en$"), ("fr/any", 2, "^fr$"), ("html", 3, "html$")], "node string, level int, pattern string")
    return P.classify_tree(D.files(spark, sf), tree)


@query("classify_tree", f"WITH {D.FILES}, {_TREE} SELECT path, node FROM cls")
def q_classify(spark, sf):
    return _classified(spark, sf)


@query("tree_node_files", f"WITH {D.FILES}, {_TREE} SELECT path, node FROM cls WHERE node = 'en' OR starts_with(node, 'en/')")
def q_node(spark, sf):
    return P.tree_node_files(_classified(spark, sf), "en")


@query("root_nodes", f"WITH {D.FILES}, {_TREE} SELECT DISTINCT split_part(node, '/', 1) AS root FROM cls")
def q_roots(spark, sf):
    return P.root_nodes(_classified(spark, sf))


@query("count_matches", f"WITH {D.FILES}, n AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:l], '/') AS p FROM (SELECT path, unnest(range(1, len(string_split(path, '/')) + 1)) AS l FROM files)) SELECT count(*) AS n FROM n WHERE regexp_matches(regexp_extract(p, '[^/]*$'), '^(?:en|fr)')")
def q_count(spark, sf):
    return P.count_matches(D.files(spark, sf).select(F.col("path").alias("node")), "en|fr")


@query("prune_tree", f"WITH {D.FILES}, {_TREE} SELECT path, node FROM cls WHERE NOT regexp_matches(node, 'any') AND NOT regexp_matches({_BASE}, 'any')")
def q_prune(spark, sf):
    return P.prune_tree(_classified(spark, sf), "any")


@query("copy_plan", f"WITH {D.FILES}, {_TREE}, c AS (SELECT *, count(*) OVER (PARTITION BY node) AS n, row_number() OVER (PARTITION BY node ORDER BY path) AS r FROM cls) SELECT path, CASE WHEN n = 1 THEN 'out/' || node || {_EXT} ELSE 'out/' || node || '/' || lpad(r::VARCHAR, 5, '0') || {_EXT} END AS target FROM c")
def q_plan(spark, sf):
    return P.copy_plan(_classified(spark, sf), "out")


# de-identification


@query("anonymize_headers", f"WITH {D.TAGS} SELECT file, grp, elem, vr, keyword, CASE WHEN keyword = 'PatientName' OR vr = 'PN' THEN 'Anonymous' WHEN keyword = 'PatientAddress' THEN 'North Pole' WHEN keyword = 'PatientBirthDate' THEN '' ELSE value END AS value FROM tags WHERE keyword <> 'OtherPatientIDs' AND grp % 2 = 0 AND grp & 65280 <> 20480")
def q_anon(spark, sf):
    return E.anonymize_headers(D.tags(spark, sf))


@query("anonymize_headers_fixed", f"WITH {D.TAGS} SELECT file, grp, elem, vr, keyword, CASE keyword WHEN 'PatientName' THEN 'Anonymous' WHEN 'PatientBirthDate' THEN '17000101' WHEN 'PatientAddress' THEN 'North Pole' ELSE value END AS value FROM tags")
def q_fixed(spark, sf):
    return E.anonymize_headers_fixed(D.tags(spark, sf))


_SCANS = "scans AS (SELECT c_mktsegment || (c_custkey % 20) AS folder, 'scan' || c_custkey || CASE c_custkey % 3 WHEN 0 THEN '.dcm' WHEN 1 THEN '.IMA' ELSE '.txt' END AS path, CASE WHEN c_custkey % 5 > 0 THEN 'P' || c_nationkey END AS id FROM customer)"


def _scans(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    ext = F.when(k % 3 == 0, ".dcm").when(k % 3 == 1, ".IMA").otherwise(".txt")
    return c.select(F.concat("c_mktsegment", (k % 20).cast("string")).alias("folder"), F.concat(F.lit("scan"), k.cast("string"), ext).alias("path"), F.when(k % 5 > 0, F.concat(F.lit("P"), F.col("c_nationkey").cast("string"))).alias("id"))


_FIRST = "fst AS (SELECT folder, arg_min(id, (CASE WHEN path LIKE '%.IMA' THEN 1 ELSE 6 END, path)) AS id FROM scans WHERE id IS NOT NULL AND path NOT LIKE '%.txt' GROUP BY 1)"


@query("first_patient_id", f"WITH {_SCANS}, {_FIRST} SELECT folder, id FROM fst")
def q_first(spark, sf):
    return E.first_patient_id(_scans(spark, sf))


@query("serial_names", f"WITH {_SCANS} SELECT folder, path, lpad(row_number() OVER (PARTITION BY folder, regexp_extract(path, '(\\.[^./]*)$', 1) ORDER BY path)::VARCHAR, 4, '0') || '.dcm' AS new_name FROM scans")
def q_serial(spark, sf):
    return E.serial_names(_scans(spark, sf)).select("folder", "path", "new_name")


@query("rename_folder_plan", f"WITH {_SCANS}, {_FIRST}, f AS (SELECT DISTINCT folder FROM scans) SELECT folder, coalesce(CASE WHEN length(regexp_extract(folder, 'BUILDING1[0-9]*')) > 3 THEN regexp_extract(folder, 'BUILDING1[0-9]*') END, id, folder) AS target FROM f LEFT JOIN fst USING (folder)")
def q_rename(spark, sf):
    s = _scans(spark, sf)
    return E.rename_folder_plan(s.select("folder").distinct(), s, "BUILDING1[0-9]*")


@query("deidentify_subject", f"WITH {_SCANS}, {_FIRST} SELECT path, coalesce(CASE WHEN length(regexp_extract(folder, 'BUILDING1[0-9]*')) > 3 THEN regexp_extract(folder, 'BUILDING1[0-9]*') END, id, folder) || '/' || new_name AS target_path FROM (SELECT folder, path, lpad(row_number() OVER (PARTITION BY folder, regexp_extract(path, '(\\.[^./]*)$', 1) ORDER BY path)::VARCHAR, 4, '0') || '.dcm' AS new_name FROM scans) LEFT JOIN fst USING (folder)")
def q_deid(spark, sf):
    s = _scans(spark, sf)
    return E.deidentify_subject(s.select("folder").distinct(), s, D.tags(spark, sf), "BUILDING1[0-9]*")[0]
