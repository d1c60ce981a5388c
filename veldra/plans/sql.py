"""Fragments of SQL that several queries share."""

#: A place: separators made one, outer blanks off, then single dots and climbing parts taken out step by step.
PLACE = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(file_path, '^\s+|\s+$', '', 'g'), '[\\/]+', '/', 'g'), '^(\./)+', ''), '(/\.)+/', '/', 'g'), '[^/]+/\.\./', '', 'g'), '^/', '')"""
WORD = "regexp_replace(lower(raw_split), '[^a-z]+', '', 'g')"
SPLIT = f"CASE WHEN {WORD} IN ('train', 'training', 'trn') THEN 'train' WHEN {WORD} IN ('valid', 'validation', 'val', 'devvalid', 'dev') THEN 'valid' WHEN {WORD} IN ('test', 'testing', 'tst') THEN 'test' END"
SHA = "CASE WHEN regexp_matches(lower(sha256), '^\\s*(sha-?256\\s*[:=-]?)?\\s*[0-9a-f]{64}\\s*$') THEN regexp_extract(lower(sha256), '([0-9a-f]{64})\\s*$', 1) END"
NUM = r"[+-]?(([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|[nN][aA][nN]|[iI][nN][fF])"
