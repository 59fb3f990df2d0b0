"""SQL for the pN_ queries that SQL can express."""

from strataline.sources.bad_rows import EDGE

_ONCE = "SELECT * FROM (SELECT *,row_number() OVER (PARTITION BY run_id ORDER BY (CASE WHEN coalesce(len(tasks),0)>0 THEN 1 ELSE 0 END) DESC,received_at DESC) AS rn FROM job_runs_sample) WHERE rn=1"

_MEASURES = f"WITH once AS ({_ONCE}), m AS (SELECT settings.tags.team AS team,job_id,'duration_ms' AS metric,metrics.duration_ms AS v FROM once UNION ALL SELECT settings.tags.team,job_id,'bytes_written',CAST(metrics.bytes_written AS DOUBLE) FROM once), c AS (SELECT * FROM m WHERE v IS NOT NULL AND isfinite(v)), f AS (SELECT unnest([0.01,0.05,0.25,0.5,0.75,0.9,0.95,0.99])::DOUBLE AS fraction), r AS (SELECT *,row_number() OVER (PARTITION BY {{g}} ORDER BY v)-1 AS i,count(*) OVER (PARTITION BY {{g}}) AS n FROM c) "
_PERCENTILES = "SELECT {g},fraction,round(max(CASE WHEN i=floor((n-1)*fraction) THEN v END)+(max(CASE WHEN i=ceil((n-1)*fraction) THEN v END)-max(CASE WHEN i=floor((n-1)*fraction) THEN v END))*any_value((n-1)*fraction-floor((n-1)*fraction)),3) AS value,any_value(n) AS n,CAST(0 AS BIGINT) AS rank_error FROM r,f GROUP BY {g},fraction"

ORACLE = {
    "p1_found": f"WITH once AS ({_ONCE}), t AS (SELECT run_id,unnest(tasks) AS t FROM once), a AS (SELECT run_id,t.task_key AS task_key,unnest(t.attempts) AS a FROM t WHERE t IS NOT NULL), e AS (SELECT run_id,task_key,a.attempt_no AS attempt_no,unnest(a.errors) AS e FROM a WHERE a IS NOT NULL) SELECT run_id,task_key,attempt_no,e.code AS code FROM e WHERE e IS NOT NULL",
    "p1_runs": f"WITH once AS ({_ONCE}) SELECT run_id,job_id,creator_user_name,created_time,settings.tags.team AS team,settings.tags.env AS env,cluster.num_workers AS num_workers,CASE WHEN NOT isnan(metrics.duration_ms) THEN metrics.duration_ms END AS duration_ms,CASE WHEN metrics.duration_ms IS NULL THEN 'null' WHEN isnan(metrics.duration_ms) THEN 'nan' ELSE 'number' END AS duration_state,metrics.success AS success,metrics.bytes_written AS bytes_written FROM once",
    "p1_tasks": f"WITH once AS ({_ONCE}), t AS (SELECT run_id,unnest(tasks) AS t,unnest(range(len(tasks))) AS p FROM once) SELECT run_id,CAST(p AS INTEGER) AS task_pos,t.task_key AS task_key FROM t WHERE t IS NOT NULL",
    "p1_attempts": f"WITH once AS ({_ONCE}), t AS (SELECT run_id,unnest(tasks) AS t,unnest(range(len(tasks))) AS p FROM once), a AS (SELECT run_id,p,t.task_key AS task_key,unnest(t.attempts) AS a,unnest(range(len(t.attempts))) AS q FROM t WHERE t IS NOT NULL) SELECT run_id,CAST(p AS INTEGER) AS task_pos,task_key,CAST(q AS INTEGER) AS attempt_pos,a.attempt_no AS attempt_no,a.duration_ms AS duration_ms,a.success AS success FROM a WHERE a IS NOT NULL",
    "p3_percentiles": _MEASURES.format(g="team,metric") + _PERCENTILES.format(g="team,metric"),
    "p3_by_job": _MEASURES.format(g="team,job_id,metric") + _PERCENTILES.format(g="team,job_id,metric"),
    "p3_two_weeks": _MEASURES.replace("'duration_ms' AS metric,", "'duration_ms' AS metric,created_time//86400000 AS day,").replace("'bytes_written',", "'bytes_written',created_time//86400000,").replace(
        "FROM m WHERE v IS NOT NULL AND isfinite(v))", "FROM m WHERE v IS NOT NULL AND isfinite(v) QUALIFY max(day) OVER (PARTITION BY metric)-day<14)"
    ).format(g="team,metric") + _PERCENTILES.format(g="team,metric"),
    "p4_profiles": " UNION ALL ".join(
        f"SELECT site,load_no,'{c}' AS column_name,count(*) AS row_count,count(*)-count({c}) AS null_count,count(DISTINCT {c}) AS distinct_count,"
        + (f"round(CAST(min({c}) AS DOUBLE),4) AS min_value,round(CAST(max({c}) AS DOUBLE),4) AS max_value,round(avg({c}),4) AS mean_value" if c in ("id", "score") else "CAST(NULL AS DOUBLE) AS min_value,CAST(NULL AS DOUBLE) AS max_value,CAST(NULL AS DOUBLE) AS mean_value")
        + " FROM people GROUP BY site,load_no"
        for c in ("id", "name", "score", "active", "grp", "badge")
    ),
}

# The range and stuck rules of problem 5 and the check that follows the daily profiles. SQL has no pursuit: readings that the check alone
# would take, such as a short level of its own (tests/test_spikes.py), do not occur in these data.
ORACLE["p5_found"] = r"""
WITH once AS (SELECT * FROM (SELECT *,row_number() OVER (PARTITION BY run_id ORDER BY received_at DESC) AS rn FROM job_runs_sample) WHERE rn=1),
r AS (SELECT job_id,run_id,created_time AS began,metrics.duration_ms AS v,coalesce(metrics.success,false) AS ok,epoch_us(received_at)/1000.0-created_time AS most FROM once),
t AS (SELECT *,coalesce(v<0 OR isnan(v) OR isinf(v) OR (v=0 AND ok) OR v>most,false) AS bad FROM r),
s AS (SELECT job_id,run_id,v,row_number() OVER (PARTITION BY job_id ORDER BY began,run_id)-row_number() OVER (PARTITION BY job_id,v ORDER BY began,run_id) AS g FROM t WHERE ok AND v IS NOT NULL AND NOT isnan(v)),
stuck AS (SELECT job_id,run_id FROM s QUALIFY count(*) OVER (PARTITION BY job_id,v,g)>=6),
big AS (SELECT job_id FROM r GROUP BY job_id HAVING count(*)>=40),
o AS (SELECT job_id,run_id,v,row_number() OVER (PARTITION BY job_id ORDER BY v) AS i,count(*) OVER (PARTITION BY job_id) AS n,lag(v) OVER (PARTITION BY job_id ORDER BY v) AS lo,lead(v) OVER (PARTITION BY job_id ORDER BY v) AS hi FROM t WHERE ok AND NOT bad AND v>0 AND job_id IN (SELECT job_id FROM big)),
cuts AS (SELECT job_id,min(CASE WHEN v>=2.9*lo AND n-i+1<=greatest(3,0.053*n) AND (n-i+1)*2<n THEN v END) AS up,max(CASE WHEN hi>=2.9*v AND i<=greatest(3,0.053*n) AND i*2<n THEN v END) AS down FROM o GROUP BY job_id)
SELECT job_id,run_id FROM t WHERE bad UNION SELECT job_id,run_id FROM stuck UNION SELECT o.job_id,run_id FROM o JOIN cuts USING (job_id) WHERE v>=up OR v<=down
"""

ORACLE["p7_found"] = r"""
WITH e AS (SELECT meta.source AS s,meta.checkpoint AS k,table_ref.name AS t,lower(trim(op)) AS op,TRY_CAST(list_filter(before,lambda x: x.field_name='id')[1].field_value AS BIGINT) AS b,TRY_CAST(list_filter("after",lambda x: x.field_name='id')[1].field_value AS BIGINT) AS a FROM cdc_event),
o AS (SELECT *,CASE WHEN regexp_full_match(k,'[0-9A-Fa-f]+/[0-9A-Fa-f]+') THEN [TRY_CAST('0x'||split_part(k,'/',1) AS HUGEINT),TRY_CAST('0x'||split_part(k,'/',2) AS HUGEINT)] WHEN regexp_matches(k,'^\d{4}-\d\d-\d\dT') THEN [TRY_CAST(epoch_us(TRY_CAST(replace(split_part(k,'#',1),'Z','') AS TIMESTAMP)) AS HUGEINT),TRY_CAST(split_part(k,'#',2) AS HUGEINT)] WHEN regexp_full_match(k,'[0-9A-Fa-f]+(-[0-9A-Fa-f]+)+:[0-9]+') THEN [TRY_CAST(split_part(k,':',-1) AS HUGEINT)] ELSE list_transform(regexp_extract_all(k,'\d+'),lambda x: TRY_CAST(x AS HUGEINT)) END AS o FROM e WHERE k IS NOT NULL),
c AS (SELECT s,t,max(o) AS cut FROM o WHERE op='truncate' GROUP BY ALL),
x AS (SELECT s,t,o,k,coalesce(a,b) AS id,1 AS w FROM o WHERE op IN ('insert','update') UNION ALL SELECT s,t,o,k,coalesce(b,a),0 FROM o WHERE op='delete' UNION ALL SELECT s,t,o,k,b,0 FROM o WHERE op='update' AND a<>b),
l AS (SELECT x.*,row_number() OVER (PARTITION BY x.s,x.t,x.id ORDER BY x.o DESC,x.w DESC) AS r FROM x LEFT JOIN c ON x.s=c.s AND x.t=c.t WHERE x.id IS NOT NULL AND (c.cut IS NULL OR x.o>c.cut))
SELECT s AS source,t AS table_name,id AS row_id,k AS checkpoint_token FROM l WHERE r=1 AND w=1
"""


def _shape(at: str, kind, depth: int = 0) -> str:
    """SQL of the shape of an expression; ``kind``: a letter, a list of (field, kind), or a set of one element kind (an array)."""
    if isinstance(kind, str):
        return f"CASE WHEN {at} IS NULL THEN '-' ELSE '{kind}' END"
    if isinstance(kind, tuple):
        inner = _shape(f"x{depth}", kind[0], depth + 1)
        return f"CASE WHEN {at} IS NULL THEN '-' WHEN len({at})=0 THEN '[]' ELSE '['||array_to_string(list_sort(list_distinct(list_transform({at},lambda x{depth}: {inner}))),'|')||']' END"
    fields = "||".join(f"({_shape(f'{at}.{name}' if at else name, k, depth)})" for name, k in kind)
    return f"CASE WHEN {at} IS NULL THEN '-' ELSE '{{'||{fields}||'}}' END" if at else f"'{{'||{fields}||'}}'"


_ERROR = [("code", "s"), ("message", "s")]
_ATTEMPT = [("attempt_no", "n"), ("duration_ms", "n"), ("success", "b")]
_TASK = [("task_key", "s"), ("depends_on", ("s",))]
_RUN = [
    ("run_id", "n"), ("job_id", "n"), ("creator_user_name", "s"), ("created_time", "n"), ("settings", [("name", "s"), ("max_concurrent_runs", "n"), ("tags", [("team", "s"), ("env", "s"), ("domain", "s")])]),
    ("cluster", [("spark_version", "s"), ("node_type_id", "s"), ("num_workers", "n")]), ("metrics", [("duration_ms", "n"), ("success", "b"), ("bytes_written", "n")]),
]
_WHOLE = [*_RUN, ("tasks", ([*_TASK, ("attempts", ([*_ATTEMPT, ("errors", (_ERROR,))],))],)), ("received_at", "o")]
_LEVELS = f"WITH once AS ({_ONCE}), t AS (SELECT unnest(tasks) AS t FROM once), a AS (SELECT unnest(t.attempts) AS a FROM t WHERE t IS NOT NULL), e AS (SELECT unnest(a.errors) AS e FROM a WHERE a IS NOT NULL) "
ORACLE["p1_whole_variants"] = f"WITH once AS ({_ONCE}) SELECT {_shape('', _WHOLE)} AS shape,count(*) AS n FROM once GROUP BY 1"
ORACLE["p1_variants"] = _LEVELS + " UNION ALL ".join(
    f"SELECT '{level}' AS level,{_shape(at, kind)} AS shape,count(*) AS n FROM {source} GROUP BY 2"
    for level, source, at, kind in (
        ("run", "once", "", [*_RUN, ("received_at", "o")]), ("task", "t WHERE t IS NOT NULL", "t", _TASK), ("attempt", "a WHERE a IS NOT NULL", "a", _ATTEMPT), ("error", "e WHERE e IS NOT NULL", "e", _ERROR),
    )
)
ORACLE["p1_error_subtypes"] = _LEVELS + f"SELECT {_shape('e', _ERROR)} AS shape,concat_ws(',','run_id,task_pos,task_key,attempt_pos,attempt_no,error_pos',CASE WHEN e.code IS NOT NULL THEN 'code' END,CASE WHEN e.message IS NOT NULL THEN 'message' END) AS columns,count(*) AS n FROM e WHERE e IS NOT NULL GROUP BY ALL"

# Problem 6: the same grammar of cells as one regular expression; each cell is a capture of the line.
_EDGE = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in EDGE) + "]"
_QUOTED_CELL = f'{_EDGE}*"(?:[^"]|"")*"{_EDGE}*'
_RAW_CELL = f'(?:{_QUOTED_CELL}|[^",]*)'
_PARSED = f"""
WITH t AS (SELECT file_no,line_no,regexp_replace(regexp_replace(coalesce(raw_line,''),'^{_EDGE}+',''),'{_EDGE}+$','') AS x FROM people_raw),
h AS (SELECT file_no,list_transform(string_split(x,','),lambda c: lower(regexp_replace(c,'^{_EDGE}+|{_EDGE}+$','','g'))) AS names FROM t WHERE line_no=1),
r AS (SELECT t.*,coalesce(h.names,['id','name','score','active']) AS names,regexp_extract_all(','||x,',({_RAW_CELL})',1) AS raw FROM t LEFT JOIN h USING (file_no) WHERE line_no<>1 AND x<>''),
c AS (SELECT *,list_transform(raw,lambda v: regexp_replace(CASE WHEN regexp_full_match(v,'{_EDGE}*".*"{_EDGE}*','s') THEN replace(regexp_extract(v,'"((?s:.*))"',1),'""','"') ELSE v END,'^{_EDGE}+|{_EDGE}+$','','g')) AS cells FROM r),
f AS (SELECT *,nullif(cells[list_position(names,'id')],'') AS id,nullif(cells[list_position(names,'name')],'') AS name,nullif(cells[list_position(names,'score')],'') AS score,lower(nullif(cells[list_position(names,'active')],'')) AS active FROM c),
p AS (SELECT *,CASE WHEN NOT regexp_full_match(x,'{_RAW_CELL}(?:,{_RAW_CELL})*') THEN 'quoting' WHEN len(cells)<>len(names) THEN 'column_count'
WHEN id IS NOT NULL AND (NOT regexp_full_match(id,'[+-]?[0-9]+') OR TRY_CAST(id AS BIGINT) IS NULL) THEN 'bad_id' WHEN score IS NOT NULL AND NOT regexp_full_match(score,'[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN 'bad_score'
WHEN active IS NOT NULL AND active NOT IN ('true','t','1','yes','y','false','f','0','no','n') THEN 'bad_active' END AS reason FROM f)
"""
ORACLE["p6_found"] = _PARSED + "SELECT file_no,line_no,reason FROM p WHERE reason IS NOT NULL"
ORACLE["p6_people"] = _PARSED + "SELECT file_no,line_no,CAST(id AS BIGINT) AS id,name,CAST(score AS DOUBLE) AS score,active IN ('true','t','1','yes','y') AS active FROM p WHERE reason IS NULL"

# Problem 7 with images, and rows from before the feed appended.
_IMAGE = "array_to_string(list_sort(list_transform(img,lambda x: x.field_name||'='||coalesce(x.field_value,'null'))),';')"
ORACLE["p7_rows"] = (
    ORACLE["p7_found"].replace('AS a FROM cdc_event', 'AS a,before AS bi,"after" AS ai FROM cdc_event')
    .replace("coalesce(a,b) AS id,1 AS w FROM", "coalesce(a,b) AS id,1 AS w,CASE WHEN op='insert' OR a<>b THEN ai ELSE coalesce(ai,bi) END AS img FROM")
    .replace("coalesce(b,a),0 FROM", "coalesce(b,a),0,NULL FROM").replace("id AS row_id,k AS checkpoint_token FROM l", f"id AS row_id,k AS checkpoint_token,{_IMAGE} AS image FROM l")
    .replace("s,t,o,k,b,0 FROM o", "s,t,o,k,b,0,NULL FROM o")
    + " UNION ALL SELECT 'before','region',CAST(r_regionkey AS BIGINT),'0','name='||r_name FROM region"
)

# Problem 2: keys of objects, arrays not entered.
_KEYS = "json_valid(payload) AND json_type(payload)='OBJECT' AND t.fullkey<>'$' AND t.fullkey NOT LIKE '%[%'"
ORACLE["p2_kinds"] = f"""
SELECT feed,file_no,replace(substr(t.fullkey,3),'"','') AS path,CASE t.type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS kind,count(*) AS n
FROM job_run_files,json_tree(payload) t WHERE {_KEYS} GROUP BY ALL
"""
ORACLE["p2_unified_cells"] = f"""
WITH once AS (SELECT DISTINCT feed,file_no,line_no,payload FROM job_run_files WHERE json_valid(payload) AND json_type(payload)='OBJECT'),
k AS (SELECT feed,file_no,count(*) AS n FROM once,json_tree(payload) t WHERE {_KEYS} AND t.type<>'NULL' AND (t.type<>'OBJECT' OR t.value='{{}}') GROUP BY ALL)
SELECT feed,file_no,count(*) AS n_rows,CAST(coalesce(any_value(k.n),0) AS BIGINT) AS n_cells FROM once LEFT JOIN k USING (feed,file_no) GROUP BY ALL
"""

# Problem 4: shapes and their merging into words under the same code lengths. SQL's regular expressions have no back-references, so
# expressions of repeated words are left out; none is the shortest on these data.
_RUNS = "length(regexp_replace({0},'[^Aa9w]','','g'))"


def _own(code: str, alphabet: int, pieces: str) -> str:
    return f"digits*log2(10)+letters*log2({alphabet})+log2(longest-shortest+1)*{pieces}+n*log2(total/n)+length({code})*log2(96)+{_RUNS.format(code)}*12+16"


ORACLE["p4_conformity"] = rf"""
WITH v AS (SELECT site,load_no,'name' AS column_name,name AS value FROM people UNION ALL SELECT site,load_no,'grp',grp FROM people UNION ALL SELECT site,load_no,'badge',badge FROM people),
k AS (SELECT *,regexp_replace(regexp_replace(regexp_replace(value,'\p{{Lu}}+','A','g'),'\p{{Ll}}+','a','g'),'[0-9]+','9','g') AS shape FROM v WHERE value IS NOT NULL),
s AS (SELECT site,column_name,shape,regexp_replace(shape,'[Aa]+','w','g') AS words,count(*) AS n,min(length(value)) AS shortest,max(length(value)) AS longest,sum(length(value)) AS chars,sum(length(regexp_replace(value,'[^0-9]','','g'))) AS digits,sum(length(regexp_replace(value,'[^\p{{Lu}}\p{{Ll}}]','','g'))) AS letters FROM (SELECT DISTINCT site,column_name,shape,value FROM k) GROUP BY ALL),
q AS (SELECT *,sum(n) OVER (PARTITION BY site,column_name) AS total,n*{_RUNS.format("shape")} AS pieces,n*{_RUNS.format("words")} AS word_pieces FROM s),
c AS (SELECT *,{_own("shape", 26, "pieces")} AS own,chars*log2(96)+n*(log2(longest+1)+1) AS free FROM q),
one AS (SELECT *,n>1 AND own<free AS kept,CASE WHEN n>1 AND own<free THEN own ELSE free END AS cost FROM c),
two AS (SELECT site,column_name,words,total,sum(n) AS n,min(shortest) AS shortest,max(longest) AS longest,sum(digits) AS digits,sum(letters) AS letters,sum(word_pieces) AS word_pieces,sum(cost) AS apart FROM one GROUP BY ALL),
w AS (SELECT * FROM two WHERE n>1 AND {_own("words", 52, "word_pieces")}<apart),
x AS (SELECT one.site,one.column_name,one.shape,CASE WHEN w.words IS NOT NULL THEN w.words WHEN one.kept THEN one.shape END AS code,coalesce(w.shortest,one.shortest) AS lo,coalesce(w.longest,one.longest) AS hi FROM one LEFT JOIN w ON one.site=w.site AND one.column_name=w.column_name AND one.words=w.words),
e AS (SELECT site,column_name,shape,'^(?=[\s\S]{{'||lo||','||hi||'}}$)'||replace(replace(replace(replace(regexp_replace(code,'([^\p{{L}}\p{{N}}\s])','\\\1','g'),'w','[\p{{Lu}}\p{{Ll}}]+'),'A','\p{{Lu}}+'),'a','\p{{Ll}}+'),'9','[0-9]+')||'$' AS expression FROM x WHERE code IS NOT NULL)
SELECT k.site,load_no,k.column_name,count(*) AS held,count(*)-count(expression) AS nonconforming,coalesce(string_agg(DISTINCT expression,' | ' ORDER BY expression),'') AS expressions FROM k LEFT JOIN e ON k.site=e.site AND k.column_name=e.column_name AND k.shape=e.shape GROUP BY ALL
"""
