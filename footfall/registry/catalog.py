"""B: catalog, lookup and selection."""

from pyspark.sql import functions as F

from footfall.registry import fixtures as fx
from footfall.registry.base import query
from footfall.registry.fixtures import sql
from footfall.sources import catalog as ca, selection as se, texts as tx

MISSIONS_SQL = "SELECT id, folder, name FROM fx_catalog"
ALIASES_SQL = "SELECT alias || '-' || id AS alias, id, 1 pos FROM fx_catalog WHERE id % 3 = 0 UNION ALL SELECT 'x-' || id, id, 0 FROM fx_catalog WHERE id % 4 = 0"
REQUEST_SQL = "SELECT CASE WHEN id % 6 = 0 THEN alias || '-' || id WHEN id % 5 = 0 THEN 'nobody-' || id ELSE CAST(id AS VARCHAR) END AS key FROM fx_catalog"
RESOLVED_SQL = """SELECT q.key, m.id, m.folder, CASE WHEN m.id IS NOT NULL THEN coalesce(CASE WHEN a.id IS NOT NULL THEN q.key END, f.first_alias, m.name, m.folder) END display
    FROM (SELECT DISTINCT key FROM request) q LEFT JOIN aliases a ON a.alias = q.key LEFT JOIN missions m ON CAST(m.id AS VARCHAR) = coalesce(CAST(a.id AS VARCHAR), q.key)
    LEFT JOIN (SELECT id, min_by(alias, pos) first_alias FROM aliases GROUP BY 1) f ON f.id = m.id"""
CV = dict(missions=MISSIONS_SQL, aliases=ALIASES_SQL, request=REQUEST_SQL, resolved=RESOLVED_SQL)


def _parts(spark, sf):
    entries = fx.catalog(spark, sf).withColumn("id", F.col("id").cast("string"))
    n = F.col("id").cast("long")
    missions = entries.select("id", "folder", "name")
    aliases = entries.where(n % 3 == 0).select(F.concat_ws("-", "alias", "id").alias("alias"), "id", F.lit(1).alias("pos")).unionByName(
        entries.where(n % 4 == 0).select(F.concat(F.lit("x-"), "id").alias("alias"), "id", F.lit(0).alias("pos")))
    key = F.when(n % 6 == 0, F.concat_ws("-", "alias", "id")).when(n % 5 == 0, F.concat(F.lit("nobody-"), "id")).otherwise(F.col("id"))
    return missions, aliases, entries.select(key.alias("key"), n.alias("n"))


@query("B1_mission_resolution", sql("SELECT key, id, folder FROM resolved", "fx_catalog", **CV))
def _(spark, sf):
    missions, aliases, request = _parts(spark, sf)
    return ca.resolve(request.select("key").distinct(), aliases, missions).select("key", F.col("id").cast("long"), "folder")


@query("B1_unresolved", sql("SELECT key FROM resolved WHERE id IS NULL", "fx_catalog", **CV))
def _(spark, sf):
    missions, aliases, request = _parts(spark, sf)
    return ca.unresolved(ca.resolve(request.select("key").distinct(), aliases, missions))


@query("B2_display_name", sql("SELECT key, display FROM resolved WHERE id IS NOT NULL", "fx_catalog", **CV))
def _(spark, sf):
    missions, aliases, request = _parts(spark, sf)
    return ca.resolve(request.select("key").distinct(), aliases, missions).where("id IS NOT NULL").select("key", "display")


FOLDER_IDS = "SELECT CAST(id % 700 AS VARCHAR) || '-' || id AS id, CASE WHEN id % 10 = 0 THEN CAST(id % 700 + 5 AS VARCHAR) END folder FROM fx_catalog"


@query("B3_folder_assignment", sql(
    """SELECT i.id, coalesce(i.folder, CASE WHEN o.f IS NULL AND c.first = i.id THEN split_part(i.id, '-', 1) END, i.id) folder FROM ids i
    LEFT JOIN (SELECT DISTINCT folder f FROM ids WHERE folder IS NOT NULL) o ON o.f = split_part(i.id, '-', 1)
    LEFT JOIN (SELECT split_part(id, '-', 1) s, min(id) AS first FROM ids WHERE folder IS NULL GROUP BY 1) c ON c.s = split_part(i.id, '-', 1)""",
    "fx_catalog", ids=FOLDER_IDS))
def _(spark, sf):
    n = F.col("id")
    ids = fx.catalog(spark, sf).select(
        F.concat_ws("-", (n % 700).cast("string"), n.cast("string")).alias("id"), F.when(n % 10 == 0, (n % 700 + 5).cast("string")).alias("folder"))
    return ca.assign_folders(ids)


@query("B4_catalog_upsert", sql(
    """SELECT coalesce(n.id, o.id) id, coalesce(n.folder, o.folder) folder, coalesce(n.name, o.name) AS name FROM (SELECT id, folder, name FROM fx_catalog WHERE id % 5 <> 0) o
    FULL JOIN (SELECT id, CASE WHEN id % 3 = 0 THEN 'new' END folder, kind AS name FROM fx_catalog WHERE id % 2 = 0) n ON n.id = o.id""", "fx_catalog"))
def _(spark, sf):
    all_ = fx.catalog(spark, sf)
    new = all_.where("id % 2 = 0").select("id", F.when(F.col("id") % 3 == 0, "new").alias("folder"), F.col("kind").alias("name"))
    return ca.upsert(all_.where("id % 5 <> 0").select("id", "folder", "name"), new)


@query("B5_requested_missions", sql(
    """SELECT id, key FROM (SELECT r.id, l.key, row_number() OVER (PARTITION BY r.id ORDER BY l.pos) k FROM (
      SELECT key, row_number() OVER () * 0 + pos pos FROM (SELECT key, pos FROM listed)) l JOIN resolved r ON r.key = l.key AND r.id IS NOT NULL) WHERE k = 1""",
    "fx_catalog", **{"listed": """SELECT CASE WHEN id % 6 = 0 THEN alias || '-' || id WHEN id % 5 = 0 THEN 'nobody-' || id ELSE CAST(id AS VARCHAR) END AS key, id * 2 pos FROM fx_catalog
      UNION ALL SELECT CAST(id AS VARCHAR), id * 2 + 1 FROM fx_catalog WHERE id % 7 <> 0""",
      **CV, "request": "SELECT key FROM listed"}))
def _(spark, sf):
    missions, aliases, request = _parts(spark, sf)
    pad = lambda c: F.concat(F.lit("  "), c, F.lit(" "))
    lines = request.select((F.col("n") * 2).alias("pos"), pad(F.col("key")).alias("line")).unionByName(
        request.select((F.col("n") * 2 + 1).alias("pos"),
                       F.when(F.col("n") % 7 == 0, F.concat(F.lit("# "), "key")).otherwise(F.col("n").cast("string")).alias("line")))
    return ca.requested_missions(lines, aliases, missions).select(F.col("id").cast("long"), "key")


CANDIDATES = {"cmd_vel": ["/click/0", "/view/*"], "odom": ["/view/?"], "gps": ["purchase/1", "/error/2"], "imu": ["/imu/data"], "anymal_state": []}
TOKENS = {"imu": ("sign", "err"), "anymal_state": ("purchase",)}
TOPIC_SQL = """SELECT mission, key, min_by(topic, {'r': rank, 't': topic}) topic FROM (
    SELECT mission, topic, 'cmd_vel' AS key, CASE WHEN topic = '/click/0' THEN 0 WHEN topic LIKE '/click/0' THEN 1 WHEN topic LIKE '/view/%' THEN 3 END rank FROM fx_topics
    UNION ALL SELECT mission, topic, 'odom', CASE WHEN topic LIKE '/view/_' THEN 1 END FROM fx_topics
    UNION ALL SELECT mission, topic, 'gps', CASE WHEN topic LIKE '%purchase/1' THEN 1 WHEN topic = '/error/2' THEN 2 END FROM fx_topics
    UNION ALL SELECT mission, topic, 'imu', CASE WHEN topic LIKE '%sign%' OR topic LIKE '%err%' THEN 2 END FROM fx_topics
    UNION ALL SELECT mission, topic, 'anymal_state', CASE WHEN topic LIKE '%purchase%' THEN 0 END FROM fx_topics) WHERE rank IS NOT NULL GROUP BY 1, 2"""


@query("B6_topic_choice", sql(TOPIC_SQL, "fx_topics"))
def _(spark, sf):
    return se.choose_topics(fx.topics(spark, sf), CANDIDATES, TOKENS)


PATTERNS = ["synced_10Hz*.parquet", "synced_?Hz.parquet", "*_metrics.parquet", "*.tif"]


@query("B8_pattern_match", sql(
    """SELECT doc_id, name, CASE WHEN name LIKE 'synced@_10Hz%.parquet' ESCAPE '@' THEN 0 WHEN name LIKE 'synced@__Hz.parquet' ESCAPE '@' THEN 1 ELSE 2 END pattern_rank FROM fx_files
    WHERE name LIKE 'synced@_10Hz%.parquet' ESCAPE '@' OR name LIKE 'synced@__Hz.parquet' ESCAPE '@' OR name LIKE '%@_metrics.parquet' ESCAPE '@'""", "fx_files"))
def _(spark, sf):
    return se.match_patterns(fx.files(spark, sf), PATTERNS).select("doc_id", "name", "pattern_rank")


@query("B8_expanded_patterns", sql(
    """SELECT doc_id, name, CASE WHEN name = 'synced_10Hz.bag' THEN 0 WHEN name = 'synced_10Hz.mcap' THEN 1 WHEN name LIKE '%.bag' THEN 2 ELSE 3 END pattern_rank
    FROM (SELECT doc_id, replace(name, '.parquet', CASE WHEN doc_id % 3 = 0 THEN '_0.mcap' WHEN doc_id % 3 = 1 THEN '.bag' ELSE '.mcap' END) name FROM fx_files)
    WHERE name LIKE 'synced@_10Hz%.bag' ESCAPE '@' OR name LIKE 'synced@_10Hz%.mcap' ESCAPE '@'""", "fx_files"))
def _(spark, sf):
    ending = F.when(F.col("doc_id") % 3 == 0, "_0.mcap").when(F.col("doc_id") % 3 == 1, ".bag").otherwise(".mcap")
    files = fx.files(spark, sf).select("doc_id", F.replace("name", F.lit(".parquet"), ending).alias("name"))
    return se.match_patterns(files, se.expand_patterns(["synced_10Hz.bag"])).select("doc_id", "name", "pattern_rank")


@query("B9_present_patterns", sql(
    "SELECT pattern, coalesce(bool_or(regexp_matches(name, rx)), false) AS present FROM fx_files, (VALUES ('synced_10Hz*.parquet', '^synced_10Hz.*\\.parquet$'), "
    "('synced_?Hz.parquet', '^synced_.Hz\\.parquet$'), ('*_metrics.parquet', '^.*_metrics\\.parquet$'), ('*.tif', '^.*\\.tif$')) p(pattern, rx) GROUP BY 1", "fx_files"))
def _(spark, sf):
    return se.pattern_presence(fx.files(spark, sf), PATTERNS)


@query("B10_gps_gate", sql(
    "SELECT mission, bool_or(stream = 'purchase' AND v > 40) AS has_gps FROM fx_stream GROUP BY 1", "fx_stream"))
def _(spark, sf):
    rows = fx.stream(spark, sf)
    gps = rows.where("stream = 'purchase' AND v > 40").select("mission", F.col("v").alias("lat"), F.col("v").alias("lon"))
    return se.gps_gate(rows.select("mission").distinct(), gps)


LINES_SQL = r"""SELECT doc_id, line, regexp_extract_all(line, '(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b') ids FROM (
    SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '\x1b\[[0-9;]*m', '', 'g'), '\r\n|\n|\r')) line FROM documents)"""
# plain ASCII words: the two regex engines agree on their boundaries
ASCII_TOKEN = r"[A-Za-z0-9]+-[0-9]+"


@query("B12_handles", sql(
    rf"""SELECT DISTINCT doc_id, unnest(CASE WHEN len(ids) > 0 THEN list_transform(ids, lambda x: lower(x)) WHEN contains(line, '…') THEN []::VARCHAR[]
    ELSE regexp_extract_all(line, '{ASCII_TOKEN}') END) AS handle FROM lines""", lines=LINES_SQL))
def _(spark, sf):
    return tx.handles(fx.table(spark, sf, "documents"), token=ASCII_TOKEN)


UUID_SQL = "concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21, 12))"
# a table row with an id, a later one with the same id and another name, an id outside a table, and a row of two cells
LISTING = ("concat({source}, ' │ ', 'walk_', {n}, ' | ', {id}, ' | ok\n', {source}, ' | late │ ', {id}, '\n', {other}, ' alone\n', 'x | ', {other})")


@query("B12_mission_names", sql(
    """SELECT doc_id, handle, arg_min(name, line_no) AS name FROM (
    SELECT doc_id, line_no, lower(unnest(ids)) AS handle, cells[2] AS name FROM (
      SELECT doc_id, line_no, regexp_extract_all(line, '(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}') AS ids,
             list_filter(list_transform(regexp_split_to_array(line, '[│|]'), lambda c: trim(c)), lambda c: c <> '') AS cells
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM listing))
    WHERE len(cells) >= 3) GROUP BY doc_id, handle""",
    hashed="SELECT doc_id, source, md5(doc_id::VARCHAR) h, md5('o' || doc_id::VARCHAR) o FROM documents",
    listing="SELECT doc_id, concat(source, ' │ ', 'walk_', doc_id % 17, ' | ', id, ' | ok', chr(10), source, ' | late │ ', id, chr(10), other, ' alone', chr(10), 'x | ', other) AS text FROM "
            f"(SELECT doc_id, source, CASE WHEN doc_id % 2 = 0 THEN upper({UUID_SQL}) ELSE {UUID_SQL} END AS id, {UUID_SQL.replace('(h,', '(o,')} AS other FROM hashed)"))
def _(spark, sf):
    hashed = fx.table(spark, sf, "documents").selectExpr("doc_id", "source", "md5(string(doc_id)) AS h", "md5(concat('o', string(doc_id))) AS o")
    ids = hashed.selectExpr("doc_id", "source", f"if(doc_id % 2 = 0, upper({UUID_SQL}), {UUID_SQL}) AS id", UUID_SQL.replace("(h,", "(o,") + " AS other")
    listing = ids.selectExpr("doc_id", LISTING.format(source="source", n="doc_id % 17", id="id", other="other") + " AS text")
    return tx.mission_names(listing)


@query("B13_id_and_short_name", sql(
    rf"""SELECT doc_id, nullif(lower(regexp_extract(text, '(?i)\b[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}\b')), '') AS id,
    upper(coalesce(nullif(regexp_extract(text, '(?i)short\s*name\s*[|:]\s*([^\s|:]+)', 1), ''),
      nullif(regexp_extract(text, '{ASCII_TOKEN}'), ''))) short_name
    FROM (SELECT doc_id, regexp_replace(text, '\x1b\[[0-9;]*m', '', 'g') AS text FROM documents)"""))
def _(spark, sf):
    return tx.id_and_short_name(fx.table(spark, sf, "documents"), token=ASCII_TOKEN)


WANTED_SQL = """SELECT id, CASE WHEN short IS NOT NULL THEN upper(substr(kind, 1, 4)) ELSE upper(substr(regexp_extract(alias, '^[A-Z]+'), 1, 4)) END prefix,
    CASE WHEN short IS NOT NULL THEN id % 50 ELSE CASE WHEN id % 2 = 0 THEN id % 40 END END number
    FROM (SELECT *, CASE WHEN id % 3 = 0 THEN lower(substr(kind, 1, 4)) || '_' || (id % 50) END short FROM fx_catalog)"""
TAKEN_SQL = "SELECT DISTINCT upper(substr(kind, 1, 4)) prefix, CAST(length(alias) AS BIGINT) number FROM fx_catalog"
NEXT_FREE = "list_filter(range(q.s, q.s + len({used}) + 1), lambda n: NOT list_contains({used}, n))[1]"
NAMING = dict(
    wanted=WANTED_SQL, taken=TAKEN_SQL,
    queue="SELECT id, prefix, coalesce(number, 1) s, row_number() OVER (PARTITION BY prefix ORDER BY id) k FROM wanted",
    before="SELECT p.prefix, coalesce(list(t.number) FILTER (t.number IS NOT NULL), []) used FROM (SELECT DISTINCT prefix FROM wanted) p LEFT JOIN taken t USING (prefix) GROUP BY 1",
    # one id after the other, for all prefixes at once
    served=f"""SELECT id, prefix, k, n, list_append(used, n) used FROM (SELECT q.*, u.used, {NEXT_FREE.format(used='u.used')} n FROM queue q JOIN before u USING (prefix) WHERE k = 1)
      UNION ALL SELECT id, prefix, k, n, list_append(used, n) FROM (SELECT q.*, v.used, {NEXT_FREE.format(used='v.used')} n FROM served v JOIN queue q ON q.prefix = v.prefix AND q.k = v.k + 1)""")


def _wanted(spark, sf):
    entries = fx.catalog(spark, sf)
    short = F.when(F.col("id") % 3 == 0, F.concat(F.lower(F.substring("kind", 1, 4)), F.lit("_"), (F.col("id") % 50).cast("string")))
    # a date in front, the place, a number on every second one
    label = F.concat(F.lit("2024_07_"), F.regexp_extract("alias", "^[A-Z]+", 0), F.when(F.col("id") % 2 == 0, (F.col("id") % 40).cast("string")).otherwise(""), F.lit("_walk"))
    named = entries.select("id", "kind", "alias", short.alias("short"), label.alias("label"))
    return ca.split_name(named).select("id", "prefix", "number")


@query("B14_short_names", sql(
    "SELECT id, prefix || '-' || CAST(n AS VARCHAR) short_name FROM served", "fx_catalog", recursive=True, **NAMING))
def _(spark, sf):
    taken = fx.catalog(spark, sf).select(F.upper(F.substring("kind", 1, 4)).alias("prefix"), F.length("alias").cast("long").alias("number")).distinct()
    return ca.assign_short_names(_wanted(spark, sf), taken).select("id", "short_name")


@query("B15_catalog_export", sql(
    """SELECT coalesce(n.id, o.id) id, coalesce(n.name, o.name) AS name FROM (SELECT id, name FROM fx_catalog WHERE id % 5 <> 0) o FULL JOIN (
    SELECT id, kind || id AS name FROM fx_catalog WHERE id % 2 = 0 AND contains(kind || id, 'MACH') ORDER BY name, id LIMIT 20) n ON n.id = o.id""", "fx_catalog"))
def _(spark, sf):
    all_ = fx.catalog(spark, sf)
    fresh = all_.where("id % 2 = 0").select("id", F.concat("kind", F.col("id").cast("string")).alias("name"))
    return ca.export_entries(fresh, all_.where("id % 5 <> 0").select("id", "name"), "MACH", 20)
