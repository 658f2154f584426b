"""DuckDB SQL for the queries that SQL can express. The others (2: determinant estimates, 6: components of fingerprints,
7: byte-pair merges, 8: the language model's doubles, 9: fitted trees) are held against brute force in tests/llm."""

from __future__ import annotations

_CHAT = r"""WITH c AS (SELECT conv_id, turn, coalesce(role,'') AS role, coalesce(text,'') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, CASE WHEN regexp_matches(text, '### |</turn>|\\\\|\\$') THEN replace(replace(replace(text,'\','\\'),'### ','\### '),'</turn>','\</turn>') ELSE text END AS body, CASE role WHEN 'user' THEN 4 WHEN 'system' THEN 6 WHEN 'assistant' THEN 9 ELSE 4 END AS label FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role||chr(10)||text||chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, coalesce(sum(CASE WHEN role='assistant' THEN length(text) END),0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(CASE WHEN role='assistant' THEN text END, '' ORDER BY turn, role, text),'')) AS loss_sha256, sum(length(body)+label+14)::BIGINT AS formatted_chars FROM e GROUP BY conv_id"""


def _places(kind: int, name: str, pattern: str, keep: str) -> str:
    """Rows (doc_id, k, name, s, e) of one rule: the pieces between matches and the matches' own lengths give the places."""
    return f"""SELECT doc_id, {kind} AS k, '{name}' AS name, s, s+length(m) AS e FROM (SELECT doc_id, m, (list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i-1], lambda x: length(x))),0))::BIGINT AS s FROM (
 SELECT doc_id, found, pieces, unnest(found) AS m, generate_subscripts(found,1) AS i FROM (SELECT doc_id, regexp_extract_all(text,'{pattern}') AS found, regexp_split_to_array(text,'{pattern}') AS pieces FROM d) WHERE len(found)>0)) WHERE {keep}"""


_ASSIGN = r"(?:(?i:password|passwd|secret|token|api_?key))[\"'']?\x20*[:=]\x20*[\"'']?[A-Za-z0-9+/_.=-]+"
_VALUE = r"length(regexp_extract(m,'^(?:(?i:password|passwd|secret|token|api_?key))[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)',1))>=6"
_SPANS = " UNION ALL ".join([
    _places(0, "assign", _ASSIGN, _VALUE), _places(1, "access", "AKIA[A-Z0-9]+", "length(m)>=20"), _places(2, "hex", "[0-9a-f]+", "length(m)>=24"), _places(3, "forge", "gh[opsur]_[A-Za-z0-9]+", "length(m)>=40"),
    _places(4, "chat", "xox[abprs]-[A-Za-z0-9-]+", "length(m)>=15"), _places(5, "cloud", "AIza[A-Za-z0-9_-]+", "length(m)>=39"), _places(6, "pem", "-----BEGIN [A-Z ]*PRIVATE KEY-+", "length(m)>=5"),
])
_SECRETS = f"""WITH d AS (SELECT doc_id, coalesce(text,'') AS text FROM documents), spans AS ({_SPANS}),
a AS (SELECT doc_id, count(CASE WHEN k=0 THEN 1 END) AS n_assign, count(CASE WHEN k=1 THEN 1 END) AS n_access, count(CASE WHEN k=2 THEN 1 END) AS n_hex, string_agg(CASE WHEN k<3 THEN name||':'||s||':'||e END, ',' ORDER BY s, k) AS base, string_agg(name||':'||s||':'||e, ',' ORDER BY s, k) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign,0) AS n_assign, coalesce(n_access,0) AS n_access, coalesce(n_hex,0) AS n_hex, sha256(coalesce(base,'')) AS base_sha256, coalesce(spans,'') AS spans FROM d LEFT JOIN a USING (doc_id)"""

_WARC = """WITH p AS (SELECT page_id, coalesce(html,'') AS t, sha256(coalesce(html,'')) AS payload_digest, strlen(coalesce(html,''))::BIGINT AS payload_bytes FROM pages), f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes>=100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id IS NULL OR first_id=page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first_id<>page_id THEN first_id END AS refers_to FROM p LEFT JOIN f USING (payload_digest)"""

#: The given tables hold one page template; the article's blocks are h1 and p, its character references these four.
_HTML = r"""WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html,''),'(?s)<article>(.*?)</article>',1) AS x FROM pages), b AS (SELECT page_id, url, regexp_replace(regexp_replace(x,'</?(?:p|h1|br)>',' ','g'),'</?[a-z][^>]*>','','g') AS x FROM a),
c AS (SELECT page_id, url, replace(replace(replace(replace(replace(x,'&quot;','"'),'&lt;','<'),'&gt;','>'),'&#39;',''''),'&amp;','&') AS x FROM b), d AS (SELECT page_id, url, trim(regexp_replace(x,'[ \t\n\r\f\x0b]+',' ','g'),' ') AS text FROM c) SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM d"""

_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w<>'')"
#: n_near_items by its definition: of each window the two rarest places whose terms occur in the corpus are anchors; an
#: item is near a document that has two of its anchors, less than a window apart, within 4 words of their distance.
_HITS = f"""WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents), items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark), it AS (SELECT item, w, least(13,len(w)) AS width FROM items WHERE len(w)>0),
win AS (SELECT item, width, w, unnest(generate_series(0, len(w)-width)) AS s FROM it), win2 AS (SELECT item, width, s, list_slice(w, s+1, s+width) AS ws FROM win), places AS (SELECT item, s, width, unnest(ws) AS term, s+generate_subscripts(ws,1)-1 AS pos FROM win2),
tok AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w,1)-1 AS loc FROM docs), terms AS (SELECT DISTINCT term FROM places), cnt AS (SELECT term, count(*) AS n FROM tok WHERE term IN (SELECT term FROM terms) GROUP BY term),
rk AS (SELECT item, pos, term, width, row_number() OVER (PARTITION BY item, s ORDER BY n, pos) AS r FROM places JOIN cnt USING (term)), anchors AS (SELECT DISTINCT item, pos, term, width FROM rk WHERE r<=2),
fnd AS (SELECT DISTINCT doc_id, item, width, pos, loc-pos AS shift FROM tok JOIN anchors USING (term)), met AS (SELECT doc_id, item, any_value(width) AS width, shift, list(DISTINCT pos) AS met FROM fnd GROUP BY doc_id, item, shift),
near AS (SELECT DISTINCT a.doc_id, a.item FROM fnd a JOIN fnd b ON a.doc_id=b.doc_id AND a.item=b.item WHERE a.pos<b.pos AND b.pos-a.pos<a.width AND abs(a.shift-b.shift)<=4),
cand AS (SELECT m.doc_id, m.item, m.shift, x.s, x.ws, x.width FROM met m JOIN win2 x ON m.item=x.item WHERE len(m.met)>=least(2,m.width)), hit AS (SELECT c.doc_id, c.item, unnest(generate_series(c.shift+c.s, c.shift+c.s+c.width-1)) AS p FROM cand c JOIN docs d USING (doc_id) WHERE c.shift+c.s>=0 AND list_slice(d.w, c.shift+c.s+1, c.shift+c.s+c.width)=c.ws),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit, count(DISTINCT item) AS n_items FROM hit GROUP BY doc_id), hs AS (SELECT doc_id, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id), nn AS (SELECT doc_id, count(*) AS n_near_items FROM near WHERE (doc_id, item) NOT IN (SELECT (doc_id, item) FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit,0) AS n_hit, coalesce(n_items,0) AS n_items, sha256(coalesce(items,'')) AS items_sha256, coalesce(n_hit,0)>0 AND 20*coalesce(n_hit,0)>=len(w) AS contaminated, coalesce(n_near_items,0) AS n_near_items FROM docs LEFT JOIN h USING (doc_id) LEFT JOIN hs USING (doc_id) LEFT JOIN nn USING (doc_id)"""

_REPEATS = r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text,''),'[\x20\x09-\x0D]+'), lambda w: w<>'') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(list_slice(w,s,s+12),' ') AS k FROM (SELECT doc_id, w, unnest(generate_series(1,len(w)-12)) AS s FROM d)), low AS (SELECT k, min(doc_id) AS lo FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(generate_series(s,s+12)) AS p FROM win JOIN low USING (k) WHERE doc_id>lo)), tok AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w,1) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM tok ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id), n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed,0) AS n_removed, sha256(coalesce(t,'')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)"""


def _crc(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit: character codes are mixed in, and -1 stands for one shift."""
    step = "CASE WHEN x=-1 THEN xor(a>>1, CASE WHEN a&1=1 THEN 3988292384 ELSE 0 END) ELSE xor(a,x) END"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({text},''), lambda c: [ord(c)::BIGINT,-1,-1,-1,-1,-1,-1,-1,-1]))), lambda a, x: {step}), 4294967295)"


def _leaf(text: str) -> str:
    parts = [f"coalesce(strlen(({x})::VARCHAR)||':'||({x})::VARCHAR,'-')" for x in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({'||'.join(parts)})"


#: up: all nodes below the subroots and these; top: those above. steps: for each leaf the siblings left and right of its way, from its run (k=0) on.
_MERKLE = f"""WITH RECURSIVE l0 AS (SELECT doc_id, source, {_leaf('text')} AS leaf, CASE WHEN {_crc('doc_id::VARCHAR')}&1=0 THEN {_leaf("replace(text,chr(10),'')")} END AS bad FROM documents),
l AS (SELECT row_number() OVER () AS r, doc_id, source, leaf, coalesce(bad,leaf) AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf)-1 AS i, count(*) OVER (PARTITION BY source) AS n FROM l0),
up AS (SELECT source, 0 AS lvl, i, n, leaf AS d FROM l UNION ALL SELECT source, lvl+1, i//3, (any_value(n)+2)//3, sha256(string_agg(d,'' ORDER BY i)) FROM up WHERE n>1 GROUP BY source, lvl, i//3),
subs AS (SELECT source, d AS subroot, row_number() OVER (ORDER BY source NULLS FIRST)-1 AS i, count(*) OVER () AS n FROM up WHERE n=1), top AS (SELECT 0 AS lvl, i, n, subroot AS d FROM subs UNION ALL SELECT lvl+1, i//3, (any_value(n)+2)//3, sha256(string_agg(d,'' ORDER BY i)) FROM top WHERE n>1 GROUP BY lvl, i//3),
near AS (SELECT r, lvl, u.i, u.d, l.i//pow(3,lvl)::BIGINT AS own FROM l JOIN up u ON u.source IS NOT DISTINCT FROM l.source AND u.n>1 AND u.i//3=l.i//pow(3,lvl)::BIGINT//3 UNION ALL SELECT r, 1000+lvl, u.i, u.d, s.i//pow(3,lvl)::BIGINT FROM l JOIN subs s ON s.source IS NOT DISTINCT FROM l.source JOIN top u ON u.n>1 AND u.i//3=s.i//pow(3,lvl)::BIGINT//3),
steps AS (SELECT r, row_number() OVER (PARTITION BY r ORDER BY lvl)-1 AS k, coalesce(string_agg(d,'' ORDER BY i) FILTER (i<own),'') AS a, coalesce(string_agg(d,'' ORDER BY i) FILTER (i>own),'') AS b FROM near GROUP BY r, lvl),
folds AS (SELECT r, 0 AS k, t AS d FROM l UNION ALL SELECT r, k+1, sha256(a||d||b) FROM folds JOIN steps USING (r, k)), ends AS (SELECT r, arg_max(d,k) AS folded_root FROM folds GROUP BY r), proofs AS (SELECT r, sha256(string_agg(a||b,'' ORDER BY k)) AS p FROM steps GROUP BY r)
SELECT doc_id, leaf, subroot, root, coalesce(p, sha256('')) AS proof_sha256, folded_root, folded_root=root AS verified FROM l JOIN ends USING (r) LEFT JOIN proofs USING (r) JOIN subs ON subs.source IS NOT DISTINCT FROM l.source CROSS JOIN (SELECT d AS root FROM top WHERE n=1)"""

_TRIE = rf"""WITH c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role,''), coalesce(text,''))-1 AS p, coalesce(role,'') AS role, coalesce(text,'') AS text FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, {_crc('conv_id::VARCHAR')}&3 AS h, conv_id-conv_id%20 AS base FROM (SELECT DISTINCT conv_id FROM c)),
b AS (SELECT i.conv_id, 0 AS part, p, role, text FROM ids i JOIN c ON c.conv_id=i.base AND p<h UNION ALL SELECT conv_id, 1, p, role, text FROM ids JOIN c USING (conv_id) WHERE p>=h),
s AS (SELECT conv_id, list(length(role)||':'||role||text ORDER BY part, p) AS ks, list(len(regexp_extract_all(text,'[^\x20\x09-\x0D]+')) ORDER BY part, p) AS ws FROM b GROUP BY conv_id),
a AS (SELECT conv_id, coalesce(ks,[]) AS ks, coalesce(ws,[]) AS ws FROM ids LEFT JOIN s USING (conv_id)),
pre AS (SELECT conv_id, d, sha256(array_to_string(list_transform(ks[1:d], lambda x: sha256(x)),'')) AS k, sha256(array_to_string(list_transform(ks[1:d-1], lambda x: sha256(x)),'')) AS up, CASE WHEN d>0 THEN ws[d] ELSE 0 END AS w, d=len(ks) AS fin FROM (SELECT *, unnest(generate_series(0,len(ks))) AS d FROM a)),
nodes AS (SELECT d, k, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n, any_value(w) AS w, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (fin),'')) AS ends FROM pre GROUP BY d, k),
kids AS (SELECT d-1 AS d, up AS k, count(*) AS nc FROM nodes WHERE d>0 GROUP BY d, up), own AS (SELECT nodes.*, coalesce(nc,0) AS nc, (n-1)*w AS saved FROM nodes LEFT JOIN kids USING (d, k)),
ways AS (SELECT DISTINCT x.d, x.k, y.d AS vd, y.k AS vk FROM pre x JOIN pre y ON x.conv_id=y.conv_id AND y.d>=x.d), sums AS (SELECT ways.d, ways.k, sum(CASE WHEN nc=0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM ways JOIN own o ON o.d=vd AND o.k=vk GROUP BY ways.d, ways.k)
SELECT o.conv_id, o.d::BIGINT AS depth, p.conv_id AS parent_conv_id, o.n AS n_convs, o.nc AS n_children, n_leaves, saved_tokens, o.ends AS ends_sha256 FROM own o JOIN sums s ON s.d=o.d AND s.k=o.k LEFT JOIN nodes p ON p.d=o.d-1 AND p.k=o.up AND o.d>0"""

ORACLES: dict[str, str] = {"op1_chat_format": _CHAT, "op3_secret_scan": _SECRETS, "op4_warc": _WARC, "op5_html_extract": _HTML, "op10_decontaminate": _HITS, "op11_prefix_trie": _TRIE, "op12_merkle_manifest": _MERKLE, "op13_substring_dedup": _REPEATS}
