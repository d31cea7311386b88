"""DuckDB SQL for the license scan, with its own list of sentences in normal form and of rules."""

# Sentences of public licences in normal form with their identifiers; then licence, first identifier of a
# rule, pattern of the identifiers that follow, and pattern of longer rules that the rule gives way to.
ORACLE = r"""
WITH known(sentence, id) AS (VALUES
    ('licensed under the apache license version 2 0', 'apache_notice'),
    ('licensed under the apache license version 2 0 the license', 'apache_notice'),
    ('licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license', 'apache_notice_long'),
    ('you may obtain a copy of the license at', 'apache_copy'),
    ('unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied', 'apache_as_is'),
    ('see the license for the specific language governing permissions and limitations under the license', 'apache_see'),
    ('released under the mit license', 'mit_notice'),
    ('licensed under the mit license', 'mit_notice'),
    ('this project is licensed under the mit license', 'mit_notice'),
    ('permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions', 'mit_grant'),
    ('the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software', 'mit_keep'),
    ('the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement', 'mit_as_is'),
    ('permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies', 'isc_grant'),
    ('redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met', 'bsd_grant'),
    ('redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer', 'bsd_source'),
    ('redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution', 'bsd_binary'),
    ('neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission', 'bsd_names'),
    ('this work is licensed under the gnu general public license version 3', 'gpl3_notice'),
    ('licensed under the gnu general public license version 3', 'gpl3_notice'),
    ('this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version', 'gpl3_grant'),
    ('this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose', 'gpl_warranty'),
    ('licensed under cc by 4 0', 'ccby_notice'),
    ('licensed under cc by sa 4 0', 'ccbysa_notice'),
    ('licensed under cc by nc 4 0', 'ccbync_notice'),
    ('this work is licensed under a creative commons attribution 4 0 international license', 'ccby_long'),
    ('this work is licensed under a creative commons attribution sharealike 4 0 international license', 'ccbysa_long'),
    ('this work is licensed under a creative commons attribution noncommercial 4 0 international license', 'ccbync_long'),
    ('all rights reserved', 'rights_reserved'),
    ('this work is licensed under the gnu general public license version 2', 'gpl2_notice'),
    ('licensed under the gnu general public license version 2', 'gpl2_notice'),
    ('this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version', 'gpl2_grant'),
    ('licensed under the gnu lesser general public license version 2 1', 'lgpl21_notice'),
    ('licensed under the gnu lesser general public license version 3', 'lgpl3_notice'),
    ('licensed under the gnu affero general public license version 3', 'agpl3_notice'),
    ('licensed under the mozilla public license version 2 0', 'mpl2_notice'),
    ('this source code form is subject to the terms of the mozilla public license v', 'mpl2_notice'),
    ('licensed under cc0 1 0', 'cc0_notice'),
    ('to the extent possible under law the author has waived all copyright and related or neighboring rights to this work', 'cc0_waiver'),
    ('this is free and unencumbered software released into the public domain', 'unlicense_notice'),
    ('spdx license identifier gpl 2 0 only', 'spdx_gpl2'),
    ('spdx license identifier gpl 2 0 or later', 'spdx_gpl2'),
    ('spdx license identifier gpl 3 0 or later', 'spdx_gpl3'),
    ('spdx license identifier lgpl 2 1 only', 'spdx_lgpl21'),
    ('spdx license identifier lgpl 2 1 or later', 'spdx_lgpl21'),
    ('spdx license identifier lgpl 3 0 only', 'spdx_lgpl3'),
    ('spdx license identifier lgpl 3 0 or later', 'spdx_lgpl3'),
    ('spdx license identifier agpl 3 0 only', 'spdx_agpl3'),
    ('spdx license identifier agpl 3 0 or later', 'spdx_agpl3'),
    ('spdx license identifier mpl 2 0', 'spdx_mpl2'),
    ('spdx license identifier cc0 1 0', 'spdx_cc0'),
    ('spdx license identifier unlicense', 'spdx_unlicense'),
    ('spdx license identifier apache 2 0', 'spdx_apache'),
    ('spdx license identifier mit', 'spdx_mit'),
    ('spdx license identifier gpl 3 0 only', 'spdx_gpl3'),
    ('this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version', 'lgpl21_grant'),
    ('this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose', 'lgpl_warranty'),
    ('this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version', 'lgpl3_grant'),
    ('this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version', 'agpl3_grant'),
    ('this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation', 'gpl2_notice'),
    ('licensed under the bsd 2 clause license', 'bsd2_notice'),
    ('bsd 2 clause license', 'bsd2_notice'),
    ('licensed under the bsd 3 clause license', 'bsd3_notice'),
    ('bsd 3 clause license', 'bsd3_notice'),
    ('this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed', 'bsd_as_is'),
    ('mit license', 'mit_notice'),
    ('the mit license mit', 'mit_notice'),
    ('this code is licensed under the mit license', 'mit_notice'),
    ('isc license', 'isc_notice'),
    ('licensed under the isc license', 'isc_notice'),
    ('licensed under the eclipse public license 2 0', 'epl2_notice'),
    ('this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0', 'epl2_notice'),
    ('this software is provided as is without any express or implied warranty', 'zlib_as_is'),
    ('permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions', 'zlib_grant'),
    ('distributed under the boost software license version 1 0', 'boost_notice'),
    ('boost software license version 1 0', 'boost_notice'),
    ('mozilla public license version 2 0', 'mpl2_notice'),
    ('licensed under cc0 1 0 universal', 'cc0_notice'),
    ('licensed under cc by nd 4 0', 'ccbynd_notice'),
    ('licensed under cc by nc sa 4 0', 'ccbyncsa_notice'),
    ('licensed under cc by nc nd 4 0', 'ccbyncnd_notice'),
    ('this work is licensed under a creative commons attribution noderivatives 4 0 international license', 'ccbynd_long'),
    ('this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license', 'ccbyncsa_long'),
    ('this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license', 'ccbyncnd_long'),
    ('spdx license identifier bsd 2 clause', 'spdx_bsd2'),
    ('spdx license identifier bsd 3 clause', 'spdx_bsd3'),
    ('spdx license identifier isc', 'spdx_isc'),
    ('spdx license identifier epl 2 0', 'spdx_epl2'),
    ('spdx license identifier zlib', 'spdx_zlib'),
    ('spdx license identifier bsl 1 0', 'spdx_boost'),
    ('spdx license identifier cc by 4 0', 'spdx_ccby'),
    ('spdx license identifier cc by sa 4 0', 'spdx_ccbysa'),
    ('licensed under the gnu gpl v2', 'gpl2_notice'),
    ('licensed under the gplv2', 'gpl2_notice'),
    ('licensed under the gnu gpl v3', 'gpl3_notice'),
    ('licensed under the gplv3', 'gpl3_notice'),
    ('licensed under the gnu lgpl v2 1', 'lgpl21_notice'),
    ('licensed under the gnu lgpl v3', 'lgpl3_notice'),
    ('licensed under the gnu agpl v3', 'agpl3_notice'),
    ('licensed under the isc license isc', 'isc_notice'),
    ('licensed under the unlicense', 'unlicense_notice'),
    ('licensed under the creative commons attribution 4 0 international license', 'ccby_notice'),
    ('licensed under the creative commons attribution sharealike 4 0 international license', 'ccbysa_notice'),
    ('licensed under the creative commons attribution noncommercial 4 0 international license', 'ccbync_notice'),
    ('spdx license identifier gpl 2 0', 'spdx_gpl2'),
    ('spdx license identifier gpl 3 0', 'spdx_gpl3'),
    ('spdx license identifier lgpl 2 1', 'spdx_lgpl21'),
    ('spdx license identifier lgpl 3 0', 'spdx_lgpl3'),
    ('spdx license identifier agpl 3 0', 'spdx_agpl3')
), rules(licence, head, rest, longer) AS (VALUES
    ('Apache-2.0', 'apache_notice', '', ''),
    ('Apache-2.0', 'apache_notice_long', '', ''),
    ('Apache-2.0', 'apache_copy', ' apache_as_is .* apache_see ', ''),
    ('Apache-2.0', 'spdx_apache', '', ''),
    ('MIT', 'mit_notice', '', ''),
    ('MIT', 'mit_grant', ' mit_keep .* mit_as_is ', ''),
    ('MIT', 'spdx_mit', '', ''),
    ('ISC', 'isc_grant', '', ''),
    ('BSD-2-Clause', 'bsd_grant', ' bsd_source .* bsd_binary ', ' bsd_source .* bsd_binary .* bsd_names '),
    ('BSD-3-Clause', 'bsd_grant', ' bsd_source .* bsd_binary .* bsd_names ', ''),
    ('GPL-3.0', 'gpl3_notice', '', ''),
    ('GPL-3.0', 'gpl3_grant', ' gpl_warranty ', ''),
    ('GPL-3.0', 'spdx_gpl3', '', ''),
    ('CC-BY-4.0', 'ccby_notice', '', ''),
    ('CC-BY-4.0', 'ccby_long', '', ''),
    ('CC-BY-SA-4.0', 'ccbysa_notice', '', ''),
    ('CC-BY-SA-4.0', 'ccbysa_long', '', ''),
    ('CC-BY-NC-4.0', 'ccbync_notice', '', ''),
    ('CC-BY-NC-4.0', 'ccbync_long', '', ''),
    ('All-rights-reserved', 'rights_reserved', '', ' bsd_grant .* bsd_source .* bsd_binary | bsd_grant .* bsd_source .* bsd_binary .* bsd_names '),
    ('GPL-2.0', 'gpl2_notice', '', ''),
    ('GPL-2.0', 'gpl2_grant', ' gpl_warranty ', ''),
    ('GPL-2.0', 'spdx_gpl2', '', ''),
    ('LGPL-2.1', 'lgpl21_notice', '', ''),
    ('LGPL-2.1', 'spdx_lgpl21', '', ''),
    ('LGPL-3.0', 'lgpl3_notice', '', ''),
    ('LGPL-3.0', 'spdx_lgpl3', '', ''),
    ('AGPL-3.0', 'agpl3_notice', '', ''),
    ('AGPL-3.0', 'spdx_agpl3', '', ''),
    ('MPL-2.0', 'mpl2_notice', '', ''),
    ('MPL-2.0', 'spdx_mpl2', '', ''),
    ('CC0-1.0', 'cc0_notice', '', ''),
    ('CC0-1.0', 'cc0_waiver', '', ''),
    ('CC0-1.0', 'spdx_cc0', '', ''),
    ('Unlicense', 'unlicense_notice', '', ''),
    ('Unlicense', 'spdx_unlicense', '', ''),
    ('LGPL-2.1', 'lgpl21_grant', ' lgpl_warranty ', ''),
    ('LGPL-2.1', 'lgpl21_grant', ' gpl_warranty ', ''),
    ('LGPL-3.0', 'lgpl3_grant', ' gpl_warranty ', ''),
    ('AGPL-3.0', 'agpl3_grant', ' gpl_warranty ', ''),
    ('BSD-2-Clause', 'bsd2_notice', '', ''),
    ('BSD-2-Clause', 'spdx_bsd2', '', ''),
    ('BSD-2-Clause', 'rights_reserved', ' bsd_grant .* bsd_source .* bsd_binary ', ' bsd_grant .* bsd_source .* bsd_binary .* bsd_names '),
    ('BSD-3-Clause', 'bsd3_notice', '', ''),
    ('BSD-3-Clause', 'spdx_bsd3', '', ''),
    ('BSD-3-Clause', 'rights_reserved', ' bsd_grant .* bsd_source .* bsd_binary .* bsd_names ', ''),
    ('ISC', 'isc_notice', '', ''),
    ('ISC', 'spdx_isc', '', ''),
    ('EPL-2.0', 'epl2_notice', '', ''),
    ('EPL-2.0', 'spdx_epl2', '', ''),
    ('Zlib', 'zlib_as_is', ' zlib_grant ', ''),
    ('Zlib', 'spdx_zlib', '', ''),
    ('BSL-1.0', 'boost_notice', '', ''),
    ('BSL-1.0', 'spdx_boost', '', ''),
    ('CC-BY-4.0', 'spdx_ccby', '', ''),
    ('CC-BY-SA-4.0', 'spdx_ccbysa', '', ''),
    ('CC-BY-ND-4.0', 'ccbynd_notice', '', ''),
    ('CC-BY-ND-4.0', 'ccbynd_long', '', ''),
    ('CC-BY-NC-SA-4.0', 'ccbyncsa_notice', '', ''),
    ('CC-BY-NC-SA-4.0', 'ccbyncsa_long', '', ''),
    ('CC-BY-NC-ND-4.0', 'ccbyncnd_notice', '', ''),
    ('CC-BY-NC-ND-4.0', 'ccbyncnd_long', '', '')
), d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_replace(coalesce(text, ''), ',[\x20\x09-\x0D]+([Ss]ee )', '. \1', 'g') AS body FROM documents
), readings AS (
  SELECT rid, 'l' AS kind, replace(body, chr(10), '. ' || chr(10)) AS body FROM d
  UNION ALL
  SELECT rid, 'p', regexp_replace(body, '\n[\x20\x09\x0B-\x0D]*\n', '. ', 'g') FROM d
), parts AS (
  SELECT rid, kind, string_split(regexp_replace(body, '([.!?])[\x20\x09-\x0D]+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM readings
), sentences AS (
  SELECT rid, kind, generate_subscripts(parts, 1) AS pos, unnest(parts) AS s FROM parts
), normal AS (
  SELECT rid, kind, pos, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) AS s FROM sentences
), unknown AS (
  SELECT rid, kind, pos, s, regexp_matches(s, '^[a-z0-9 ]+ is (free software you can redistribute it and or modify it under the terms of the gnu |distributed in the hope that it will be useful but )') AS grants
  FROM normal WHERE s LIKE '% %' AND s NOT IN (SELECT sentence FROM known)
), slots AS (
  SELECT rid, kind, pos, 'spdx' AS slot, string_split_regex(replace(regexp_replace(s[25:], ' with [a-z0-9]+( [a-z0-9]+)*? (exception|note)( [0-9]+)*', '', 'g'), ' or later', ' orlater'), ' or | and ') AS fillings
  FROM unknown WHERE starts_with(s, 'spdx license identifier ')
  UNION ALL
  SELECT rid, kind, pos, 'program', [s] FROM unknown WHERE grants AND NOT starts_with(s, 'spdx license identifier ')
  UNION ALL
  SELECT rid, kind, pos, 'notice', string_split_regex(regexp_replace(
    regexp_extract(s, '^([a-z0-9 ]+ )?(licensed|released|distributed|redistributed|available|published|provided) under (the )?(terms of )?(either )?(of )?(the )?(.*)$', 8),
    ' see [a-z0-9 ]+$| or (at your option )?(any )?later( versions?)?( see [a-z0-9 ]+)?$| only$', ''), ' (or|and) (the )?')
  FROM unknown
  WHERE NOT grants AND NOT starts_with(s, 'spdx license identifier ') AND NOT regexp_matches(s, '\b(not|never|cannot|unless|longer|formerly|previously|neither|nor)\b')
    AND regexp_matches(s, '^([a-z0-9 ]+ )?(licensed|released|distributed|redistributed|available|published|provided) under ')
), fillings AS (
  SELECT rid, kind, pos, slot, generate_subscripts(fillings, 1) AS nth, unnest(fillings) AS filling FROM slots
), asked AS (
  SELECT rid, kind, pos, nth, slot, CASE slot
    WHEN 'spdx' THEN replace(filling, ' orlater', ' or later')
    WHEN 'program' THEN regexp_replace(regexp_replace(filling, '^.* is (free|distributed) ', 'x is \1 '), '( either)? version ([0-9 ]+) of the license( or at your option any later version)?$', ' \2')
    ELSE regexp_replace(trim(regexp_replace(regexp_replace(filling, '\b(license|licence|version)\b|\bv([0-9])', '\2', 'g'), ' +', ' ', 'g')), ' 0$', '') END AS asked
  FROM fillings
), answers AS (
  SELECT 'spdx' AS slot, s AS asked, id FROM (SELECT sentence[25:] AS s, id FROM known WHERE starts_with(sentence, 'spdx license identifier '))
  UNION ALL
  SELECT 'program', s, min(id) FROM (
    SELECT regexp_replace(regexp_replace(sentence, '^.* is (free|distributed) ', 'x is \1 '), '( either)? version ([0-9 ]+) of the license( or at your option any later version)?$', ' \2') AS s, id
    FROM known WHERE regexp_matches(sentence, '^this (program|library) is (free software|distributed in)')) GROUP BY s
  UNION ALL
  SELECT 'notice', s, min(id) FROM (
    SELECT regexp_replace(trim(regexp_replace(regexp_replace(regexp_extract(sentence, '^licensed under (the )?(.+)$', 2), '\b(license|version)\b|\bv([0-9])', '\2', 'g'), ' +', ' ', 'g')), ' 0$', '') AS s, id
    FROM known WHERE starts_with(sentence, 'licensed under ')) GROUP BY s
), named AS (
  SELECT rid, kind, pos, 0 AS nth, id FROM normal JOIN known ON s = sentence
  UNION ALL
  SELECT rid, kind, pos, nth, id FROM asked JOIN answers USING (slot, asked)
), ids AS (
  SELECT rid, kind, ' ' || string_agg(id, '  ' ORDER BY pos, nth) || ' ' AS ids, count(*) AS n FROM named GROUP BY rid, kind
), found AS (
  SELECT DISTINCT rid, licence FROM ids, rules
  WHERE len(list_filter(string_split(ids, ' ' || head || ' ')[2:], lambda x: (rest = '' OR regexp_matches(x, rest)) AND NOT (longer <> '' AND regexp_matches(x, longer)))) > 0
), licences AS (
  SELECT rid, string_agg(licence, ',' ORDER BY licence) AS licenses FROM found GROUP BY rid
), n AS (
  SELECT rid, max(n) AS n, max(CASE WHEN kind = 'l' THEN replace(trim(ids), '  ', ' ') END) AS sentence_ids FROM ids GROUP BY rid
)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_sentences, coalesce(sentence_ids, '') AS sentence_ids, coalesce(licenses, '') AS licenses
FROM d LEFT JOIN n USING (rid) LEFT JOIN licences USING (rid)
"""
