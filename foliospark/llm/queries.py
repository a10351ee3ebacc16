"""The queries of the training-data operators, and their SQL where SQL can state them."""

from __future__ import annotations

from . import cuts, encoding, languages, lookalikes, markup, packing, pieces, scans, sentences

QUERIES = {
    "p1_found": sentences.p1_found,
    "p2_found": lookalikes.p2_found,
    "p2_forms": lookalikes.p2_forms,
    "p3_found": pieces.p3_found,
    "p3_pieces": pieces.p3_pieces,
    "p4_found": markup.p4_found,
    "p4_clean": markup.p4_clean,
    "p5_found": languages.p5_found,
    "p5_languages": languages.p5_languages,
    "p6_found": scans.p6_found,
    "p7_ids": encoding.p7_ids,
    "p8_packs": packing.p8_packs,
    "p8_fill": packing.p8_fill,
    "p9_found": cuts.p9_found,
    "p9_rates": cuts.p9_rates,
}

#: Problem 3's size is an expression, so its query has an equal in SQL.
SQL = {
    "p3_found": r"""
    WITH profile AS (
      SELECT document_id, arg_max(coalesce(profile_id, 'default'), (ingested_at, profile_id)) AS profile_id
      FROM docmeta WHERE document_id IS NOT NULL GROUP BY document_id),
    sized AS (
      SELECT para_id, document_id,
             length(regexp_replace(text, '[^\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7A3}]', '', 'g')) AS counted,
             len(regexp_extract_all(text, '[^\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7A3}]+')) AS words
      FROM odl_paragraphs WHERE text IS NOT NULL)
    SELECT DISTINCT para_id FROM sized
    LEFT JOIN profile USING (document_id)
    LEFT JOIN chunk_policy c ON c.profile_id = profile.profile_id
    CROSS JOIN (SELECT child_tokens AS child FROM chunk_policy WHERE profile_id = 'default') d
    WHERE counted + round_even(words * 1.3, 0) > coalesce(c.child_tokens, d.child)
    """
}
