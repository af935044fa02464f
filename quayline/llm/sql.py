"""The package's queries as plain SQL, where SQL can express them.

Not here: packing and byte-level BPE (tokenizers), SimHash, shards and sketches (XXH64, CRC-32) and
the classifier; those are tested against brute force.
"""

from __future__ import annotations

from html.entities import html5

from quayline.llm import warc
from quayline.llm.license_rules import ANCHORS, CONFIDENCE, RULES
from quayline.llm.line_quality import LIMITS
from quayline.llm.secret_scan import ALLOWED, ASSIGN, CANDIDATE, CLASSES, KINDS, SHORTEST, WINDOW

WORD = r"[^\x20\x09-\x0D]+"
A_TO_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


LINE_QUALITY = f"""
    WITH doc AS (
        SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text FROM documents
    ),
    split AS (SELECT row, regexp_extract_all(text, '{WORD}') AS words FROM doc),
    word AS (SELECT row, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM split),
    windows AS (
        SELECT row, pos, word, lead(word) OVER near AS second, lead(word, 2) OVER near AS third
        FROM word WINDOW near AS (PARTITION BY row ORDER BY pos)
    ),
    repeated AS (
        SELECT row, unnest(list(pos)) AS pos FROM windows WHERE third IS NOT NULL
        GROUP BY row, word, second, third HAVING count(*) >= 2
    ),
    inside AS (
        SELECT row, count(DISTINCT pos + step) AS n FROM repeated, (SELECT unnest([0, 1, 2]) AS step) GROUP BY row
    ),
    text AS (
        SELECT row_number() OVER () AS tid, * FROM (
            SELECT source, text, any_value(len(words)) AS n_words FROM doc JOIN split USING (row) GROUP BY source, text
        )
    ),
    placed AS (
        SELECT tid, source, line, len(regexp_extract_all(line, '{WORD}')) AS words, pos,
               trim(regexp_replace(regexp_replace(translate(line, {A_TO_Z}), '[\\x20\\x09-\\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g')) AS norm
        FROM (SELECT tid, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM text)
        WHERE regexp_matches(line, '{WORD}')
    ),
    beside AS (
        SELECT *, lag(norm) OVER near AS before, lead(norm) OVER near AS after FROM placed WINDOW near AS (PARTITION BY tid ORDER BY pos)
    ),
    line AS (
        SELECT tid, source, norm, words AS size, before, after, sum(words) OVER (PARTITION BY tid, norm) AS words
        FROM beside QUALIFY row_number() OVER (PARTITION BY tid, norm ORDER BY pos) = 1
    ),
    repeats AS (
        SELECT row, r.n FROM (SELECT tid, count(*) - count(DISTINCT line) AS n FROM placed GROUP BY tid) r
        JOIN text USING (tid) JOIN doc ON doc.text = text.text AND doc.source IS NOT DISTINCT FROM text.source
    ),
    host AS (SELECT source, count(*) AS texts FROM text GROUP BY source),
    shared AS (SELECT source, norm, count(*) AS texts FROM line GROUP BY source, norm HAVING count(*) > 1),
    marked AS (
        SELECT line.*, shared.texts FROM line LEFT JOIN shared ON shared.norm = line.norm AND shared.source IS NOT DISTINCT FROM line.source
    ),
    alike AS (
        SELECT tid FROM marked JOIN text USING (tid) WHERE marked.texts IS NOT NULL
        GROUP BY tid, n_words HAVING sum(words) >= {LIMITS.alike} * n_words
    ),
    slot AS (
        SELECT tid, source, norm, words, texts, follows, other FROM (
            SELECT *, unnest([before, after]) AS other, unnest([true, false]) AS follows FROM marked SEMI JOIN alike USING (tid)
        ) WHERE other IS NOT NULL
    ),
    usual AS (
        SELECT source, follows, other, norm, count(*) AS n FROM slot WHERE texts IS NOT NULL GROUP BY source, follows, other, norm
        QUALIFY row_number() OVER (PARTITION BY source, follows, other ORDER BY count(*) DESC, md5(norm) DESC) = 1
    ),
    instead AS (
        SELECT slot.tid, slot.norm, any_value(slot.words) AS words, bool_or(usual.norm IS NOT NULL AND own.norm IS NULL) AS instead
        FROM slot
        LEFT JOIN usual ON usual.other = slot.other AND usual.follows = slot.follows AND usual.source IS NOT DISTINCT FROM slot.source AND usual.n > 1
        LEFT JOIN (SELECT DISTINCT tid, norm FROM slot WHERE texts IS NOT NULL) own ON own.tid = slot.tid AND own.norm = usual.norm
        WHERE slot.texts IS NULL GROUP BY slot.tid, slot.norm
    ),
    kind AS (
        SELECT tid, coalesce(2 * sum(CASE WHEN instead THEN words ELSE 0 END) >= sum(words), true) AS copy
        FROM alike LEFT JOIN instead USING (tid) GROUP BY tid
    ),
    weighed AS (
        SELECT source, norm, any_value(size) AS size, any_value(texts) AS texts, count(*) FILTER (copy IS NULL) AS whole,
               count(*) FILTER (copy = false) AS own, count(copy) AS alike
        FROM marked LEFT JOIN kind USING (tid) WHERE texts >= {LIMITS.texts} GROUP BY source, norm
    ),
    above AS (
        SELECT weighed.source, norm FROM weighed JOIN host ON host.source IS NOT DISTINCT FROM weighed.source
        WHERE {LIMITS.texts} * whole + CASE WHEN 2 * own >= alike THEN own ELSE 0 END >= {LIMITS.texts ** 2}
          AND (size >= {LIMITS.long} OR weighed.texts > {LIMITS.share} * host.texts)
    ),
    gone AS (
        SELECT row, g.n FROM (
            SELECT tid, sum(words) AS n FROM line JOIN above ON above.norm = line.norm AND above.source IS NOT DISTINCT FROM line.source GROUP BY tid
        ) g JOIN text USING (tid) JOIN doc ON doc.text = text.text AND doc.source IS NOT DISTINCT FROM text.source
    ),
    counted AS (
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
               CAST(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
               CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
               CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(inside.n, 0) AS BIGINT) AS n_repeat_words,
               coalesce(gone.n, 0) AS gone
        FROM doc JOIN split USING (row) LEFT JOIN repeats USING (row) LEFT JOIN inside USING (row) LEFT JOIN gone USING (row)
    ),
    failed AS (
        SELECT *, n_words < {LIMITS.words} OR n_repeat_words > {LIMITS.repeated} * n_words AS base_failed FROM counted
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND n_words - gone >= {LIMITS.remaining} * n_words AS kept
    FROM failed
"""


def spans_sql(kind: str, pattern: str, value: int = 0) -> str:
    """row, start, end and the matched value of each match: running lengths of gaps and matches."""
    return f"""
        SELECT row, {KINDS.index(kind)} AS kind, value, found, stop - length(found) AS start, stop AS "end"
        FROM (
            SELECT row, found, value, sum(length(gap) + length(found)) OVER (PARTITION BY row ORDER BY i) AS stop
            FROM (
                SELECT row, unnest(regexp_extract_all(text, {quoted(pattern)}, 0)) AS found,
                       unnest(regexp_extract_all(text, {quoted(pattern)}, {value})) AS value,
                       unnest(string_split_regex(text, {quoted(pattern)})[:-2]) AS gap,
                       generate_subscripts(regexp_extract_all(text, {quoted(pattern)}, 0), 1) AS i
                FROM doc WHERE regexp_matches(text, {quoted(pattern)})
            )
        )
    """


def _class_of(column: str) -> str:
    tests = []
    for kind in CLASSES:
        letters = kind.alphabet.replace("-", "") + ("-" if "-" in kind.alphabet else "")
        tests.append(f"WHEN regexp_full_match({column}, '[{letters}]+') THEN {kind.bits}")
    return f"CASE {' '.join(tests)} END"


SECRETS = f"""
    WITH doc AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
    base AS (
        SELECT * FROM ({spans_sql('assign', ASSIGN, 2)}) WHERE length(value) >= {SHORTEST['assign']}
        UNION ALL SELECT * FROM ({spans_sql('access', 'AKIA[A-Z0-9]+')}) WHERE length(value) >= {SHORTEST['access']}
        UNION ALL SELECT * FROM ({spans_sql('hex', '[0-9a-f]{%d,}' % SHORTEST['hex'])})
    ),
    candidate AS ({spans_sql('entropy', CANDIDATE)}),
    possible AS (
        SELECT DISTINCT value, {_class_of('value')} AS bits FROM candidate
        WHERE NOT regexp_full_match(value, {quoted('|'.join(f'({rule})' for rule in ALLOWED))})
    ),
    part AS (
        SELECT value, bits, first, unnest(string_split(substr(value, first, {WINDOW}), '')) AS character
        FROM (SELECT value, bits, unnest(generate_series(1, length(value) - {WINDOW} + 1)) AS first FROM possible)
    ),
    entropies AS (
        SELECT value, bits, first, -sum(n / {WINDOW}.0 * log2(n / {WINDOW}.0)) AS entropy
        FROM (SELECT value, bits, first, character, count(*) AS n FROM part GROUP BY ALL) GROUP BY ALL
    ),
    random AS (SELECT DISTINCT value FROM entropies WHERE entropy >= bits - 1e-9),
    added AS (
        SELECT candidate.* FROM candidate JOIN random USING (value)
        WHERE NOT EXISTS (
            SELECT 1 FROM base WHERE base.row = candidate.row AND base.start < candidate."end" AND candidate.start < base."end"
        )
    ),
    named AS (
        SELECT *, ['{"', '".join(KINDS)}'][kind + 1] || ':' || CAST(start AS BIGINT) || ':' || CAST("end" AS BIGINT) AS name
        FROM (SELECT * FROM base UNION ALL SELECT * FROM added)
    ),
    listed AS (
        SELECT row, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
               string_agg(name, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(name, ',' ORDER BY start, kind) AS spans
        FROM named GROUP BY row
    )
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM doc LEFT JOIN listed USING (row)
"""

_LICENCE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_RULE_ROWS = ", ".join(
    f"({i}, {r.priority}, {quoted(r.label)}, [{', '.join(map(quoted, r.keywords))}], {quoted(r.also)}, {quoted(rf'\b({r.pattern})\b')})"
    for i, r in enumerate(RULES)
)


def phrase_sql(label: str, phrase: str) -> str:
    words = phrase.split(" ")
    same = " AND ".join(f"words[i + {j}] = '{w}'" for j, w in enumerate(words))
    return f"""
        SELECT row, i - 1 AS start, '{label}' AS label
        FROM (SELECT row, words, unnest(generate_series(1, len(words) - {len(words) - 1})) AS i FROM split WHERE contains(line, ' {phrase} '))
        WHERE {same}
    """


LICENSES = f"""
    WITH doc AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
    split AS (
        SELECT row, words, ' ' || array_to_string(words, ' ') || ' ' AS line
        FROM (SELECT row, regexp_extract_all(translate(text, {A_TO_Z}), '{_LICENCE_WORD}') AS words FROM doc)
    ),
    place AS ({' UNION ALL '.join(phrase_sql(*p) for p in [('mit', 'mit license'), ('apache', 'apache license'), ('gpl', 'general public license')])}),
    base AS (
        SELECT row, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list(DISTINCT label) AS names FROM place GROUP BY row
    ),
    rule(rule, priority, label, keywords, also, pattern) AS (VALUES {_RULE_ROWS}),
    -- rules are ASCII, so that other letters may be any letter
    gated AS (
        SELECT row, line, regexp_replace(line, '[^\\x00-\\x7F]', 'x', 'g') AS plain FROM split
        WHERE {' OR '.join(f"contains(line, '{anchor}')" for anchor in ANCHORS)}
    ),
    tried AS (
        SELECT row, rule, priority, label, regexp_extract_all(plain, pattern, 0) AS found, string_split_regex(plain, pattern) AS gaps
        FROM gated JOIN rule ON contains(line, ' ' || also) AND len(list_filter(keywords, lambda k: contains(line, ' ' || k))) > 0
        WHERE regexp_matches(plain, pattern)
    ),
    match AS (
        SELECT row, rule, priority, label, sum(gap_spaces + own_spaces) OVER (PARTITION BY row, rule ORDER BY i) - own_spaces - 1 AS start, own_spaces
        FROM (
            SELECT *, length(gap) - length(replace(gap, ' ', '')) AS gap_spaces, length(own) - length(replace(own, ' ', '')) AS own_spaces
            FROM (
                SELECT row, rule, priority, label, unnest(found) AS own, unnest(gaps[:-2]) AS gap, generate_subscripts(found, 1) AS i FROM tried
            )
        )
    ),
    detection AS (SELECT *, start + own_spaces + 1 AS "end" FROM match),
    standing AS (
        SELECT d.* FROM detection d WHERE NOT EXISTS (
            SELECT 1 FROM detection e
            WHERE e.row = d.row AND ((e.start <= d.start AND d."end" <= e."end") OR (d.start <= e.start AND e."end" <= d."end"))
              AND (e.priority < d.priority OR (e.priority = d.priority
                   AND (e.own_spaces > d.own_spaces OR (e.own_spaces = d.own_spaces AND e.rule < d.rule))))
        )
    ),
    found AS (
        SELECT row, list(DISTINCT label) AS names, max(CASE priority {' '.join(f'WHEN {p} THEN {c}' for p, c in CONFIDENCE.items())} END) AS surest
        FROM standing GROUP BY row
    )
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word,
           CAST(last_word AS BIGINT) AS last_word,
           array_to_string(list_sort(coalesce(base.names, [])), ',') AS base_labels,
           array_to_string(list_sort(list_distinct(list_concat(coalesce(base.names, []), coalesce(found.names, [])))), ',') AS labels,
           CAST(greatest(CASE WHEN n_base > 0 THEN 0.5 ELSE 0 END, coalesce(surest, 0)) AS DOUBLE) AS score
    FROM doc JOIN split USING (row) LEFT JOIN base USING (row) LEFT JOIN found USING (row)
"""

_CRLF = "chr(13) || chr(10)"


def record_id_sql(*parts: str) -> str:
    name = "md5(" + " || chr(10) || ".join(parts) + ")"
    return f"""'urn:uuid:' || substr({name}, 1, 8) || '-' || substr({name}, 9, 4) || '-3' || substr({name}, 14, 3) || '-a' ||
               substr({name}, 18, 3) || '-' || substr({name}, 21, 12)"""


# references by the standard's list; code points 128 to 159 as in windows-1252: fixed values
WINDOWS_1252 = "€ ‚ƒ„…†‡ˆ‰Š‹Œ Ž  ‘’“”•–—˜™š›œ žŸ"


def entries_sql(pairs: dict) -> str:
    return "map {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in pairs.items()) + "}"


def reference_sql(own: str) -> str:
    """One match: ``names`` and ``windows`` are columns."""
    begun = ", ".join(f"names[{own}[2:{n + 1}]] || {own}[{n + 2}:]" for n in range(6, 1, -1))
    digits = f"regexp_replace({own}, '^&#[xX]?0*|;$', '', 'g')"
    hexadecimal = f"CAST(('0x' || {digits}) AS BIGINT)"
    code = f"CASE WHEN len({digits}) > 7 THEN 1114112 WHEN {digits} = '' THEN 0 WHEN {own}[3:3] IN ('x', 'X') THEN {hexadecimal} ELSE CAST({digits} AS BIGINT) END"
    valid = f"CASE WHEN {code} = 0 OR {code} > 1114111 OR {code} BETWEEN 55296 AND 57343 THEN 65533 ELSE {code} END"
    return f"""CASE WHEN {own} IS NULL THEN '' WHEN {own}[2:2] <> '#' THEN coalesce(names[{own}[2:]], {begun}, {own})
               ELSE coalesce(windows[CAST({code} AS VARCHAR)], chr(CAST({valid} AS INTEGER))) END"""


def resolved_sql(text: str) -> str:
    pattern = quoted("&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*;?)")
    pieces = f"list_zip(string_split_regex({text}, {pattern}), regexp_extract_all({text}, {pattern}))"
    return f"translate(array_to_string(list_transform({pieces}, lambda p: p[1] || {reference_sql('p[2]')}), ''), chr(160), ' ')"


def replaced_sql(text: str, pattern: str, by: str) -> str:
    return f"regexp_replace({text}, {quoted(pattern)}, {by}, 'g')"


_SPACES = "[\\t\\r\\n\\f ]+"
_TEXT = replaced_sql(replaced_sql(replaced_sql("payload", warc.HIDDEN_PATTERN, "' '"), _SPACES, "' '"), warc.BLOCK_PATTERN, "chr(10)")
_TEXT = replaced_sql(replaced_sql(resolved_sql(replaced_sql(_TEXT, warc.TAG_PATTERN, "''")), " +", "' '"), " ?\\n[ \\n]*", "chr(10)")
_TITLE = replaced_sql(resolved_sql(f"regexp_extract(payload, {quoted(warc.TITLE_PATTERN)}, 1)"), _SPACES, "' '")

WARC = f"""
    WITH page AS (
        SELECT page_id, coalesce(url, '') AS uri, coalesce(html, '') AS payload, {entries_sql(html5)} AS names,
               {entries_sql({str(128 + i): c for i, c in enumerate(WINDOWS_1252) if c != " "})} AS windows
        FROM pages
    ),
    source AS (
        SELECT *, 'sha256:' || sha256(payload) AS digest,
               'HTTP/1.1 200 OK' || {_CRLF} || 'Content-Type: text/html; charset=utf-8' || {_CRLF} || 'Content-Length: ' || strlen(payload) AS headers
        FROM page
    ),
    response AS (
        SELECT *, {record_id_sql("'response'", "coalesce(CAST(page_id AS VARCHAR), '')", 'uri', quoted(warc.UNDATED), 'digest')} AS id FROM source
    ),
    block AS (
        SELECT *, 'metadata' AS warc_type, 'application/warc-fields' AS content_type,
               'title: ' || trim({_TITLE}) || {_CRLF} || 'links: ' || len(regexp_extract_all(payload, {quoted(warc.LINK_PATTERN)})) || {_CRLF} ||
               'source-payload-digest: ' || digest || {_CRLF} || 'source-http: ' || replace(headers, {_CRLF}, {_CRLF} || 'source-http: ') || {_CRLF} AS block
        FROM response
        UNION ALL
        SELECT *, 'conversion', 'text/plain; charset=utf-8', trim({_TEXT}, ' ' || chr(10)) FROM response
    )
    SELECT page_id, warc_type, {record_id_sql('warc_type', 'id')} AS record_id, id AS refers_to, uri AS refers_to_target_uri,
           {quoted(warc.UNDATED)} AS refers_to_date, content_type, CAST(strlen(block) AS BIGINT) AS content_length,
           'sha256:' || sha256(block) AS block_digest, digest AS source_payload_digest, headers AS source_headers, block
    FROM block
"""

# levels of the Merkle SQL: 16 million rows of one source, 4,096 sources
LEAF_LEVELS, TOP_LEVELS = 6, 3


def leaf_sql(text: str) -> str:
    values = [f"CAST({c} AS VARCHAR)" for c in ("doc_id", "source", "lang", "n_chars")] + [text]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


def climb_sql(nodes: str, walk: str, levels: int) -> str:
    """Tables ``<nodes>1 ...`` of parents and ``<walk>1 ...`` of leaves that have climbed so far."""
    steps = []
    for k in range(levels):
        steps.append(f"""
    {nodes}_run{k} AS (SELECT g, pos // 16 AS up, n, list(h ORDER BY pos) AS run FROM {nodes}{k} GROUP BY ALL),
    {nodes}{k + 1} AS (
        SELECT g, up AS pos, (n + 15) // 16 AS n, CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS h FROM {nodes}_run{k}
    ),
    {walk}_pair{k} AS (
        SELECT w.*, r.n, array_to_string(run[1:pos % 16], '') AS lower_part, array_to_string(run[pos % 16 + 2:], '') AS upper_part
        FROM {walk}{k} w JOIN {nodes}_run{k} r ON r.g = w.g AND r.up = w.pos // 16
    ),
    {walk}{k + 1} AS (
        SELECT row, doc_id, g, leaf, pos // 16 AS pos, CASE WHEN n = 1 THEN cur ELSE sha256(lower_part || cur || upper_part) END AS cur,
               CASE WHEN n = 1 THEN proof ELSE proof || lower_part || upper_part END AS proof
        FROM {walk}_pair{k}
    ),""")
    return "".join(steps)


MERKLE = f"""
    WITH crc AS (
        SELECT list_transform(range(256), lambda i: list_reduce(
            list_prepend(CAST(i AS UBIGINT), list_transform(range(8), lambda x: CAST(0 AS UBIGINT))),
            lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS steps
    ),
    digits AS (SELECT row_number() OVER () AS row, *, CAST(doc_id AS VARCHAR) AS digits FROM documents),
    checked AS (
        SELECT digits.*, list_reduce(
            list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(digits, ''), lambda d: CAST(unicode(d) AS UBIGINT))),
            lambda c, d: xor(c // 256, steps[CAST(xor(c % 256, d) AS BIGINT) + 1])) AS crc
        FROM digits, crc
    ),
    hashed AS (
        SELECT row, doc_id, coalesce('s' || source, 'n') AS g, {leaf_sql("text")} AS h,
               CASE WHEN xor(crc, 4294967295) % 5 = 0 THEN {leaf_sql(f"translate(text, {A_TO_Z})")} END AS altered
        FROM checked
    ),
    leaf AS (
        SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h, row) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM hashed
    ),
    node0 AS (SELECT g, pos, n, h FROM leaf),
    walk0 AS (SELECT row, doc_id, g, h AS leaf, pos, coalesce(altered, h) AS cur, '' AS proof FROM leaf),{climb_sql("node", "walk", LEAF_LEVELS)}
    subroots AS (SELECT g AS name, h, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM node{LEAF_LEVELS}),
    top0 AS (SELECT 0 AS g, pos, n, h FROM subroots),
    top_walk0 AS (
        SELECT row, doc_id, 0 AS g, leaf, s.pos, cur, proof FROM walk{LEAF_LEVELS} w JOIN subroots s ON s.name = w.g
    ),{climb_sql("top", "top_walk", TOP_LEVELS)}
    done AS (SELECT row, leaf, cur, proof, doc_id FROM top_walk{TOP_LEVELS})
    SELECT done.doc_id, done.leaf, s.h AS subroot, t.h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = t.h AS verified
    FROM done JOIN leaf USING (row) JOIN subroots s ON s.name = leaf.g, top{TOP_LEVELS} t
"""

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms_sql(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), {A_TO_Z}), '{TERM}')"


RANKED = f"""
    WITH doc AS (SELECT row_number() OVER () AS row, doc_id, {terms_sql("text")} AS terms FROM documents),
    facts AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS total FROM doc WHERE len(terms) > 0),
    item AS (SELECT row_number() OVER () AS item, item_id, {terms_sql("text")} AS terms FROM benchmark),
    wanted AS (SELECT DISTINCT item, unnest(terms) AS term FROM item),
    held AS (
        SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM doc)
        WHERE term IN (SELECT term FROM wanted) GROUP BY row, term
    ),
    weight AS (
        SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
        FROM held, facts GROUP BY term, n_docs
    ),
    share AS (
        SELECT row, doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(terms) * n_docs) // total)) AS s
        FROM held JOIN doc USING (row), facts
    ),
    scored AS (
        SELECT item, row, doc_id, CAST(sum(w * s) AS BIGINT) AS score
        FROM wanted JOIN weight USING (term) JOIN share USING (term) GROUP BY item, row, doc_id
    ),
    placed AS (
        SELECT item, doc_id, score, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
        FROM scored WHERE score > 0
    )
    SELECT item_id, rank, doc_id, score FROM placed JOIN item USING (item) WHERE rank <= 10
"""

SQL: dict[str, str] = {
    "op4_line_quality": LINE_QUALITY,
    "op5_secret_scan": SECRETS,
    "op6_license_scan": LICENSES,
    "op10_warc_derivatives": WARC,
    "op11_merkle_manifest": MERKLE,
    "op13_ranked_search": RANKED,
}
