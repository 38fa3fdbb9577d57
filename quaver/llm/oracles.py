"""SQL that gives the same rows as a training-data query, for DuckDB."""

NOTHING = """'0','00000','0000','000','blank','empty','na','nan','nil','none','notavailable','notknown','null','tba','tbd','undefined','unknown','unknownalbum','unknownartist','unknowncharter','unknowngenre','unknownyear','unspecified','various'"""

STATED = f"""
        each AS (
            SELECT d.group_id, d.ord, i.status, i.modified_at, f.field,
                   CASE f.field WHEN 'year' THEN i.year WHEN 'genre' THEN i.genre WHEN 'charter' THEN i.charter ELSE i.album END AS value
            FROM dupgroups d JOIN ini_fields i USING (folder)
            CROSS JOIN (VALUES ('year'), ('genre'), ('charter'), ('album')) f(field)),
        bare AS (
            SELECT *, regexp_replace(lower(regexp_replace(value, '<[^>]*=[^>]*>|</[^>]*>', '', 'g')), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS b FROM each),
        stated AS (
            SELECT * FROM bare WHERE value IS NOT NULL AND b <> '' AND b NOT IN ({NOTHING})
              AND NOT regexp_full_match(b, '[0-9]{{1,3}}x+|x{{2,}}') AND NOT regexp_full_match(trim(value), '[0-9]{{1,3}}\\?+'))"""

ORACLES = {
    "p3_found": f"""
        WITH {STATED},
        held AS (
            SELECT *, row_number() OVER (PARTITION BY group_id, field
                       ORDER BY CASE WHEN status = 'confirmed_ok' THEN 0 ELSE 1 END, modified_at DESC NULLS LAST, ord) AS k
            FROM stated)
        SELECT group_id, field, value FROM held WHERE k = 1""",
    "p3_majority": f"""
        WITH {STATED},
        counted AS (SELECT group_id, field, value, count(*) AS copies FROM stated GROUP BY ALL),
        totals AS (SELECT *, sum(copies) OVER (PARTITION BY group_id, field) AS stated FROM counted)
        SELECT group_id, field, value, copies, CAST(stated AS BIGINT) AS stated FROM totals WHERE 2 * copies > stated""",
    "p4_found": """
        WITH now AS (
            SELECT *, row_number() OVER (PARTITION BY chart_hash, video_id
                       ORDER BY last_seen DESC NULLS LAST, votes DESC NULLS LAST, status DESC NULLS LAST, locked DESC NULLS LAST) AS k
            FROM mappings),
        ranked AS (
            SELECT chart_hash, video_id, row_number() OVER (PARTITION BY chart_hash
                       ORDER BY CASE status WHEN 'approved' THEN 0 ELSE 1 END, coalesce(locked, 0) DESC, coalesce(votes, 0) DESC, video_id) AS place
            FROM now WHERE k = 1 AND status IN ('approved', 'pending'))
        SELECT chart_hash, CAST(place AS BIGINT) AS place, video_id FROM ranked WHERE place <= 3""",
}
