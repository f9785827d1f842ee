"""DuckDB SQL for the queries that SQL can express, over whole tables."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A run of the signs that part words.
_SPACE = r"[\x20\x09-\x0D]+"

QUALITY = rf"""
    WITH split AS (
        SELECT doc_id, coalesce(text, '') AS text,
               list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') AS w,
               list_filter(string_split(coalesce(text, ''), chr(10)),
                           lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
        FROM documents
    ), windows AS (
        SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS five
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM split)
    ), repeated AS (
        SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, five) > 1
    ), covered AS (
        SELECT doc_id, count(DISTINCT i + k) AS n FROM repeated, (SELECT unnest(range(5)) AS k) GROUP BY doc_id
    ), tops AS (
        SELECT doc_id, max(n) AS top
        FROM (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x FROM split) GROUP BY doc_id, x)
        GROUP BY doc_id
    ), counts AS (
        SELECT split.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
               CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
               CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
               CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
               list_sum(list_transform(lines, lambda x: strlen(x))) AS line_bytes,
               list_sum(list_transform(list_distinct(lines), lambda x: strlen(x))) AS distinct_bytes,
               len(list_filter(w, lambda x: upper(x) = x AND lower(x) <> x
                                       AND length(regexp_replace(x, '[^\p{{L}}]', '', 'g')) > 1)) AS capitals,
               len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS stutters,
               coalesce(top, 0) AS top,
               length(regexp_replace(text, '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g')) AS letters
        FROM split LEFT JOIN covered USING (doc_id) LEFT JOIN tops USING (doc_id)
    ), base AS (
        SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT (base_failed OR 100 * n_symbols > 10 * n_words
                OR coalesce(1 - CAST(distinct_bytes AS DOUBLE) / CAST(line_bytes AS DOUBLE) > CAST(0.3 AS DOUBLE), false)
                OR 100 * capitals > 30 * n_words OR (n_words >= 20 AND 100 * top > 30 * n_words)
                OR 100 * stutters > 30 * n_words OR 100 * letters < 50 * word_chars
                OR word_chars > 30 * n_words) AS kept
    FROM base
"""

NEAR_DEDUP = rf"""
    WITH RECURSIVE split AS (
        SELECT doc_id, list_filter(regexp_split_to_array(
                   translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_SPACE}'), lambda x: x <> '') AS w
        FROM documents
    ), shingles AS (
        SELECT doc_id, unnest(list_distinct(
                   CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) END)) AS s
        FROM split
    ), sizes AS (
        SELECT doc_id, count(s) AS n FROM documents LEFT JOIN shingles USING (doc_id) GROUP BY doc_id
    ), common AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
        FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
    ), links AS (
        SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
        WHERE 100 * common.n >= 80 * (x.n + y.n - common.n)
    ), both_ways AS (
        SELECT a, b FROM links UNION ALL SELECT b, a FROM links
    ), reached AS (
        SELECT doc_id, doc_id AS c FROM documents
        UNION
        SELECT b, c FROM reached JOIN both_ways ON a = doc_id
    )
    SELECT doc_id, CAST(sizes.n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
    FROM sizes JOIN (SELECT doc_id, min(c) AS component_id FROM reached GROUP BY doc_id) USING (doc_id)
"""

CURRICULUM_MIX = r"""
    WITH RECURSIVE sized AS (
        SELECT doc_id, source, md5(concat_ws(':', doc_id, text)) AS place,
               CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
        FROM documents
    ), sources AS (
        SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
               [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
        FROM sized GROUP BY source
    ), shares AS (
        SELECT 0 AS round, CAST(-1 AS BIGINT) AS full_before, CAST(0 AS BIGINT) AS full_now,
               1.5::DOUBLE * sum(source_size)::DOUBLE / sum(weight)::DOUBLE AS share
        FROM sources
        UNION ALL
        SELECT round + 1, full_now, n,
               CASE WHEN free > 0 AND n <> full_now
                    THEN (1.5::DOUBLE * total::DOUBLE - taken::DOUBLE) / free::DOUBLE ELSE share END
        FROM (
            SELECT round, full_now, share, sum(source_size) AS total,
                   count(*) FILTER (weight * share > 2 * source_size) AS n,
                   coalesce(sum(2 * source_size) FILTER (weight * share > 2 * source_size), 0) AS taken,
                   coalesce(sum(weight) FILTER (weight * share <= 2 * source_size), 0) AS free
            FROM shares, sources WHERE full_now > full_before AND round < 1000
            GROUP BY round, full_now, share
        )
    ), targets AS (
        SELECT source, source_size, weight, least(weight * share, (2 * source_size)::DOUBLE) AS target
        FROM sources, (SELECT share FROM shares ORDER BY round DESC LIMIT 1)
    ), placed AS (
        SELECT sized.*, source_size, weight, target, CAST(round(target) AS BIGINT) AS quota,
               CAST(sum(size) OVER (PARTITION BY sized.source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS start
        FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
    ), takes AS (
        SELECT *, greatest(least(size, quota - start), 0) AS one,
               greatest(least(size, quota - source_size - start), 0) AS two,
               start::DOUBLE / target * weight AS area
        FROM placed
    ), pieces AS (
        SELECT *, CASE weight WHEN 3 THEN 0 WHEN 1 THEN 0 ELSE CASE WHEN area < 1 THEN 0 ELSE 0.5::DOUBLE END END::DOUBLE AS t0,
               CASE weight WHEN 3 THEN 4.5 WHEN 1 THEN 0.5 ELSE CASE WHEN area < 1 THEN 1 ELSE 3 END END::DOUBLE AS w0,
               CASE weight WHEN 3 THEN -3 WHEN 1 THEN 1 ELSE CASE WHEN area < 1 THEN 4 ELSE -4 END END::DOUBLE AS slope,
               CASE WHEN weight = 2 AND area >= 1 THEN area - 1 ELSE area END AS rest
        FROM takes
    )
    SELECT doc_id, size, source_size, target, CAST(one + two AS BIGINT) AS taken,
           CASE WHEN one + two = 0 THEN NULL WHEN rest <= 0 THEN t0
                ELSE t0 + 2 * rest / (w0 + sqrt(greatest(w0 * w0 + 2 * slope * rest, 0))) END::DOUBLE AS first_position
    FROM pieces
"""

PREFIX_TRIE = r"""
    WITH numbered AS (
        SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS n
        FROM conversations WHERE conv_id IS NOT NULL
    ), ids AS (
        SELECT conv_id, conv_id - conv_id % 100 AS base,
               xor(4294967295::UBIGINT, list_reduce(
                   [4294967295::UBIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT),
                   lambda acc, b: list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0],
                                              lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % 6 AS h
        FROM (SELECT DISTINCT conv_id FROM numbered)
    ), turns AS (
        SELECT ids.conv_id, n, role, text FROM ids JOIN numbered ON numbered.conv_id = base AND n < h
        UNION ALL
        SELECT ids.conv_id, n, role, text FROM ids JOIN numbered ON numbered.conv_id = ids.conv_id AND n >= h
    ), sequences AS (
        SELECT ids.conv_id, coalesce(s, []) AS s
        FROM ids LEFT JOIN (
            SELECT conv_id, list(md5(length(role) || ':' || role || text) ORDER BY n) AS s FROM turns GROUP BY conv_id
        ) USING (conv_id)
    ), placed AS (
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY n) AS depth, length(text) AS chars FROM turns
    ), prefixes AS (
        SELECT conv_id, s[1 : depth] AS prefix, depth, len(s) AS whole
        FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS depth FROM sequences)
    ), nodes AS (
        SELECT prefix, depth, min(prefixes.conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(chars), 0) AS chars,
               sha256(coalesce(string_agg(prefixes.conv_id::VARCHAR, ',' ORDER BY prefixes.conv_id) FILTER (depth = whole), '')) AS ends_sha256
        FROM prefixes LEFT JOIN placed USING (conv_id, depth)
        GROUP BY prefix, depth
    ), children AS (
        SELECT prefix[1 : depth - 1] AS prefix, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
    ), above AS (
        SELECT prefix[1 : k] AS prefix, k AS depth, sum((n_convs - 1) * chars) AS saved_tokens,
               sum(CASE WHEN n_children IS NULL THEN 1 ELSE 0 END) AS n_leaves
        FROM (SELECT nodes.prefix, nodes.depth, n_convs, chars, n_children, unnest(range(0, nodes.depth + 1)) AS k
              FROM nodes LEFT JOIN children ON nodes.prefix = children.prefix AND nodes.depth = children.depth)
        GROUP BY ALL
    )
    SELECT nodes.conv_id, CAST(nodes.depth AS BIGINT) AS depth, parents.conv_id AS parent_conv_id, n_convs,
           CAST(coalesce(n_children, 0) AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
           CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
    FROM nodes JOIN above ON nodes.prefix = above.prefix AND nodes.depth = above.depth
    LEFT JOIN children ON nodes.prefix = children.prefix AND nodes.depth = children.depth
    LEFT JOIN (SELECT prefix, depth, conv_id FROM nodes) parents
           ON parents.depth = nodes.depth - 1 AND parents.prefix = nodes.prefix[1 : nodes.depth - 1]
"""

HARD_NEGATIVES = """
    WITH vectors AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
        SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
               CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
        FROM vectors a JOIN vectors b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
    ), positives AS (
        SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
    )
    SELECT anchor_id, positive_id,
           CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
           id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN scored USING (anchor_id)
    WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
    QUALIFY rank <= 5
"""
