"""Sources and sinks as queries: listings, scans, markup, upserts, replacements."""

from pyspark.sql import functions as F

from sonaria.functions.scalars import squared
from sonaria.operators.listing import scan_jobs
from sonaria.plans.registry import query
from sonaria.sources import files, tables
from sonaria.sources.commits import Collection, extract, save_scan
from sonaria.sources.shared import new_path


def _files(c):
    """The instruments and manuals as a file listing of one root."""
    inst = c("instruments").select(F.lit("/r").alias("root"), F.split_part("rel_path", F.lit("/"), F.lit(1)).alias("library"), F.concat("rel_path", F.lit("."), "kind").alias("rel_path"), F.concat("name", F.lit("."), "kind").alias("name"), F.col("kind").alias("ext"), F.col("size_bytes").cast("long").alias("size_bytes"), F.col("id").alias("mtime"))
    docs = c("manuals").select(F.lit("/r").alias("root"), F.concat(F.lit("Brand#"), (F.col("library_id") % 25).cast("string")).alias("library"), F.concat_ws("/", F.col("library_id").cast("string"), F.concat(F.col("id").cast("string"), F.col("name"))).alias("rel_path"), "name", "ext", "size_bytes", F.col("id").alias("mtime"))
    return inst.unionByName(docs)


_FILES = """WITH files AS (SELECT split_part(rel_path, '/', 1) AS library, rel_path || '.' || kind AS rel_path, name || '.' || kind AS name, kind AS ext, CAST(size_bytes AS BIGINT) AS size_bytes FROM instruments
    UNION ALL SELECT 'Brand#' || (library_id % 25), library_id || '/' || id || name, name, ext, size_bytes FROM manuals)"""


@query("scan_files_aggregate", "instruments manuals", _FILES + " SELECT library, count(*) AS file_count, CAST(sum(size_bytes) AS BIGINT) AS size_bytes, count(*) FILTER (ext = 'nki') AS nki_count, count(*) FILTER (ext = 'nkm') AS nkm_count FROM files GROUP BY 1")
def scan_files_aggregate(c):
    return files.library_sums(_files(c)).select("library", "file_count", "size_bytes", "nki_count", "nkm_count")


@query("scan_roots", "roots libraries instruments", "SELECT r.path AS root_path, l.category AS library, concat(r.path, '/', l.category) AS path, count(*) AS files FROM roots r JOIN libraries l ON l.root_id = r.id JOIN instruments i ON i.library_id = l.id WHERE r.enabled AND i.id % 10 <> 0 GROUP BY 1, 2, 3")
def scan_roots(c):
    """A job for each first-level folder of the roots that are on; every tenth file lies in its root itself."""
    places = c("libraries").select(F.col("id").alias("library_id"), "root_id", "path").join(c("roots").select(F.col("id").alias("root_id"), F.col("path").alias("root_path")), "root_id")
    own = F.when(F.col("id") % 10 == 0, F.col("name")).otherwise(F.concat_ws("/", "path", "rel_path"))
    held = c("instruments").select("id", "library_id", "name", "rel_path").join(places, "library_id").select("root_path", own.alias("rel_path"))
    return scan_jobs(c("roots"), held)


@query("scan_manuals", "instruments manuals", _FILES + """, m AS (SELECT *, row_number() OVER (PARTITION BY library ORDER BY rel_path) AS rn FROM files WHERE ext IN ('pdf','rtf','chm','epub','docx','txt','html','htm') AND (contains(lower(name), 'manual') OR (NOT contains(lower(name), 'readme') AND size_bytes >= 51200)))
    SELECT library, rel_path FROM m WHERE rn <= 40""")
def scan_manuals(c):
    return files.manuals(_files(c)).select("library", "rel_path")


@query("rescan_manuals", "manuals", "SELECT id, name FROM manuals WHERE library_id = 6 AND (contains(lower(name), 'manual') OR (NOT contains(lower(name), 'readme') AND size_bytes >= 51200)) ORDER BY is_primary DESC, size_bytes DESC, id LIMIT 40")
def rescan_manuals(c):
    from sonaria.functions.scalars import looks_like_manual

    rows = c("manuals").where((F.col("library_id") == 6) & looks_like_manual(F.col("name"), F.col("size_bytes")))
    return rows.orderBy(F.desc("is_primary"), F.desc("size_bytes"), "id").limit(40).select("id", "name")


@query("scan_junk", "junk", "SELECT id, kind, suggested_keep FROM junk WHERE kind IN ('torrent','url','rar','zip','7z','exe','dmg','iso','nfo')")
def scan_junk(c):
    return c("junk").where(F.col("kind").isin(*files.JUNK)).select("id", "kind", "suggested_keep")


@query("scan_audio_clips", "clips", """WITH k AS (SELECT id, library_id, CASE WHEN ext = 'nkx' THEN 'nkx' ELSE 'sample' END AS kind, row_number() OVER w AS n, count(*) FILTER (ext = 'nkx') OVER (PARTITION BY library_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS coded FROM clips
    WHERE ext = 'nkx' OR size_bytes > 8192 WINDOW w AS (PARTITION BY library_id ORDER BY id)) SELECT id, kind FROM k WHERE CASE WHEN kind = 'nkx' THEN coded <= 240 ELSE n <= 160 END""")
def scan_audio_clips(c):
    rows = c("clips").select(F.lit("/r").alias("root"), F.col("library_id").alias("library"), F.format_string("%018d", "id").alias("rel_path"), "ext", "size_bytes", "id")
    return files.clips(rows).select("id", "kind")


@query("scan_engine_version_max", "libraries", "SELECT category AS library, arg_max(required_version, (CAST(split_part(required_version, '.', 1) AS INT), CAST(split_part(required_version, '.', 2) AS INT), CAST(split_part(required_version, '.', 3) AS INT))) AS version FROM libraries WHERE required_version <> '' GROUP BY 1")
def scan_engine_version_max(c):
    rows = c("libraries").where("required_version <> ''").select(F.col("category").alias("library"), F.col("required_version").alias("version"))
    return files.newest_versions(rows, "library", "version")


@query("plain_text_read")
def plain_text_read(c):
    return c.table("pages").select("page_id", files.plain_text("html").alias("text"))


@query("pdf_text", "", "SELECT doc_id, pos + 1 AS page_no, length(line) < 200 AS image_page FROM (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))")
def pdf_text(c):
    """Pages with little text count as images; decoding of the files is an input."""
    pages = c.table("documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return pages.select("doc_id", (F.col("pos") + 1).cast("long").alias("page_no"), (F.char_length("line") < 200).alias("image_page"))


@query("vector_blob_read", "", "SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS first, len(embedding) AS dim FROM embeddings WHERE vec_id IN (SELECT vec_id FROM embeddings WHERE label = 3)")
def vector_blob_read(c):
    """Vectors of chosen ids by a join; no batches of ids are needed."""
    wanted = c.table("embeddings").where("label = 3").select("vec_id")
    rows = c.table("embeddings").join(wanted, "vec_id", "left_semi")
    return rows.select("vec_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"), F.size("embedding").cast("long").alias("dim"))


@query("upsert_feature", "points", "SELECT clip_id, max(v) AS version FROM (SELECT clip_id, 1 AS v FROM points UNION ALL SELECT clip_id, 2 FROM points WHERE clip_id % 3 = 0) GROUP BY 1")
def upsert_feature(c):
    old = c("points").select("clip_id", F.lit(1).alias("created_at"))
    new = c("points").where("clip_id % 3 = 0").select("clip_id", F.lit(2).alias("created_at"))
    return tables.upsert_features(old, new).select("clip_id", F.col("created_at").alias("version"))


@query("replace_manuals", "manuals", """WITH n AS (SELECT CASE WHEN library_id = 7 THEN 6 ELSE library_id END AS library_id, 0 AS removed, 0 AS added FROM manuals WHERE library_id NOT IN (6, 7) UNION ALL SELECT unnest([6, 7]), 0, 0 FROM manuals WHERE library_id = 7)
    SELECT library_id, count(*) AS n, (SELECT count(*) FROM manuals WHERE library_id = 6) AS removed, (SELECT count(*) FROM manuals WHERE library_id = 7) AS added FROM n GROUP BY 1""")
def replace_manuals(c):
    """One library's manuals give way to copies of another's, as a commit; what the table then holds."""
    store = Collection(c.spark, new_path(c.spark, "manuals"))
    first = store.commit({"manuals": c("manuals")})
    old = store.read("manuals")
    new = old.where("library_id = 7").withColumn("library_id", F.lit(6).cast(old.schema["library_id"].dataType))
    table, counts = tables.replace_children(old, new, 6)
    store.commit({"manuals": table}, since=first)
    return store.read("manuals").groupBy("library_id").agg(F.count("*").alias("n")).crossJoin(counts)  # one row


@query("replace_table", "points", "SELECT clip_id, cluster FROM points WHERE cluster >= 0")
def replace_table(c):
    """The map's table, written in full and then in place of that the rows that have a cluster."""
    store = Collection(c.spark, new_path(c.spark, "map"))
    store.commit({"map_points": c("points").select("clip_id", "cluster")})
    store.commit({"map_points": store.read("map_points").where("cluster >= 0")})
    return store.read("map_points")


@query("save_scan_result", "roots libraries instruments", """SELECT l.path, CASE WHEN root_id = 1 THEN size_bytes + 1 ELSE size_bytes END AS size_bytes, (SELECT count(*) FROM instruments i WHERE i.library_id = l.id AND (root_id <> 1 OR i.kind = 'nki')) AS instruments, (SELECT count(*) FROM roots) AS roots FROM libraries l""")
def save_scan_result(c):
    """All roots are scanned and committed, then one of them again with other sizes and fewer instruments."""
    store = Collection(c.spark, new_path(c.spark, "catalog"))
    roots = c("roots").select("path", "label", F.col("id").alias("key"))
    paths = c("roots").select(F.col("id").alias("root_id"), F.col("path").alias("root_path"))
    libraries = c("libraries").join(F.broadcast(paths), "root_id").select("root_path", "path", "name", "size_bytes")  # one row a root
    held = c("instruments").join(c("libraries").select(F.col("id").alias("library_id"), F.col("path").alias("library_path")), "library_id").select("library_path", "name", "kind")
    save_scan(store, roots.drop("key"), libraries, {"instruments": held}, {"scan": "all"})
    one = roots.where("key = 1").drop("key")
    again = libraries.join(one.select(F.col("path").alias("root_path")), "root_path", "left_semi").withColumn("size_bytes", F.col("size_bytes") + 1)
    save_scan(store, one, again, {"instruments": held.where("kind = 'nki'")}, {"scan": "one"})
    counts = store.read("instruments").groupBy(F.col("library_id").alias("id")).agg(F.count("*").alias("n"))
    n = store.read("roots").count()
    return store.read("libraries").join(counts, "id", "left").select("path", "size_bytes", F.coalesce("n", F.lit(0)).alias("instruments"), F.lit(n).cast("long").alias("roots"))


@query("resumed_extraction", "", "SELECT vec_id AS clip_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))), 4) AS norm FROM embeddings")
def resumed_extraction(c):
    """A feature of every vector, in commits of a bounded number; the first run stops after two of them."""
    store = Collection(c.spark, new_path(c.spark, "features"))
    jobs = c.table("embeddings").select(F.col("vec_id").alias("clip_id"), "embedding")
    work = lambda part: part.select("clip_id", F.round(F.sqrt(squared(F.col("embedding"))), 4).alias("norm"))
    n = max(1, jobs.count() // 4)
    extract(store, jobs, work, batch=n, most_batches=2)
    extract(store, jobs, work, batch=n)
    return store.read("features")


@query("export_map_selection", "points libraries", """SELECT coalesce(l.name, '') AS library, concat('take "', clip_id, '", wav') AS file, CAST(cluster AS VARCHAR) AS cluster, round(x, 6) AS x, round(y, 6) AS y, CAST(clip_id AS VARCHAR) AS clip_id FROM points p LEFT JOIN libraries l ON l.id = p.library_id WHERE x BETWEEN 0 AND 0.1""")
def export_map_selection(c):
    """The points in a box as a CSV file with a mark of its encoding, read back."""
    path = new_path(c.spark, "selection")
    libraries = c("libraries").select(F.col("id").alias("library_id"), F.col("name").alias("library"))
    rows = c("points").where(F.col("x").between(0, 0.1)).join(libraries, "library_id", "left")
    file = F.concat(F.lit('take "'), F.col("clip_id").cast("string"), F.lit('", wav'))
    tables.write_csv(rows.select("library", file.alias("file"), "cluster", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "clip_id"), path, mark=True)
    made = tables.read_csv(c.spark, path)
    return made.withColumn("library", F.coalesce("library", F.lit(""))).withColumns({k: F.col(k).cast("double") for k in ("x", "y")})


@query("nicnt_xml_read", "libraries", "SELECT id, name, CAST(id AS VARCHAR) AS reg_key FROM libraries")
def nicnt_xml_read(c):
    xml = F.concat(F.lit("<Product><Name>"), F.col("name"), F.lit("</Name><RegKey>"), F.col("id").cast("string"), F.lit("</RegKey></Product>"))
    name, key, _ = files.product_fields(xml)
    return c("libraries").select("id", name, key)


@query("ini_section_parse", "libraries", "SELECT id, name AS section, path AS content_dir FROM libraries WHERE id % 2 = 0")
def ini_section_parse(c):
    even = F.col("id") % 2 == 0
    ini = F.concat(F.lit("[other]\nKey=sz:1\n["), F.col("name"), F.lit("]\n"), F.when(even, F.concat(F.lit("ContentDir=sz:"), F.col("path"), F.lit("\n"))).otherwise(""))
    return c("libraries").select("id", F.explode(files.ini_sections(ini)).alias("s")).select("id", "s.section", "s.content_dir")


@query("hints_xml_read", "libraries", "SELECT id, name, path FROM libraries")
def hints_xml_read(c):
    xml = F.concat(F.lit("<Hints><Library><Name>"), F.col("name"), F.lit("</Name><Path>"), F.col("path"), F.lit("</Path></Library><Library><Name>x</Name></Library></Hints>"))
    rows = c("libraries").select("id", F.explode(files.hints(xml)).alias("h"))
    return rows.where("h.Path is not null").select("id", F.col("h.Name").alias("name"), F.col("h.Path").alias("path"))
