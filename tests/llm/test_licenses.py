import re

import numpy as np

from paperlake.llm import op10_licenses as op

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(text):
    words = WORD.findall(lower(text))
    at = [(i, label) for i in range(len(words)) for p, label in PHRASES.items() if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


#: Notices as files carry them, typed anew here, and the labels that they must get; a blank line is where a name or a line of code may stand.
NOTICES = {
    "mit": """Copyright (c) 2021 A. Writer

    Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
    in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
    copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
    The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
    THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
    copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO
    THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    "0bsd": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
    THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
    AND FITNESS.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
    1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
    2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
    and/or other materials provided with the distribution.
    THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.""",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
    * Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
    * Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
    and/or other materials provided with the distribution.
    * Neither the name of Acme Works nor the names of its contributors may be used to endorse or promote products derived from this software without specific
    prior written permission.
    THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
    IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    "bsd-4-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
    1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
    2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
    and/or other materials provided with the distribution.
    3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software
    developed by Acme. 4. Neither the name of Acme nor the names of its contributors may be used to endorse or promote products derived from this software
    without specific prior written permission.""",
    "apache,apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
    You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0
    Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS.""",
    "gpl,gpl-2.0": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free
    Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "gpl,gpl-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free
    Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "lgpl-2.1": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the
    Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be
    useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "lgpl-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the
    Free Software Foundation, either version 3 of the License, or (at your option) any later version. It is distributed in the hope that it will be useful, but
    WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "agpl-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the
    Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be
    useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can
    obtain one at http://mozilla.org/MPL/2.0/.""",
    "epl-2.0": """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0
    which is available at https://www.eclipse.org/legal/epl-2.0/""",
    "cddl-1.0": """The contents of this file are subject to the terms of the Common Development and Distribution License (the "License"). You may not use this file
    except in compliance with the License.""",
    "bsl-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by
    this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software,
    and to permit third-parties to whom the Software is furnished to do so, all subject to the following:""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the
    use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute
    it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote it.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute
    this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "postgresql": """Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is
    hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.""",
    "ofl-1.1": """This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a FAQ at:""",
    "cc0-1.0": """To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain
    worldwide under the CC0 1.0 Universal Public Domain Dedication.""",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nd-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by,cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "proprietary": "Copyright 2020. All rights reserved.",
}
#: Close to a notice, or its words in another order: no label, or only that of a base phrase.
NOT_NOTICES = {
    "Permission is hereby refused, free of charge, to any person obtaining a copy of this software": "",
    "software this of copy a obtaining person any to charge of free granted hereby is permission": "",
    "rights all reserved; reserved all rights": "",
    "the Apache License in its version of 2004, not that of 2.0": "apache",
    "a public license of general use; the Mozilla project": "",
    "redistribution of water and use of the source in binary forms of modification": "",
    "the Eclipse of 2.0 suns made a public license available": "",
}
PROSE = "the old mill by the river had a wheel that turned and the software of the day was a copy of any purpose in the public use with all who came to modify it".split()


def prose(rng, n):
    return " ".join(rng.choice(PROSE, n))


def commented(rng, text):
    """The notice behind marks of comments, as in a source file."""
    mark = rng.choice(["# ", "// ", " * ", ""])
    return "\n".join(mark + line.strip() for line in text.splitlines())


def test_whole_files_get_the_labels_of_their_notices(spark):
    """Every notice alone, in prose, after code, twice, and with another one far off; the expected labels are those of the notices put in."""
    rng = np.random.default_rng(0)
    rows, want = [], []
    for labels, notice in NOTICES.items():
        files = [notice, f"{prose(rng, 300)}\n{notice}", f"{notice}\n{prose(rng, 300)}", f"{commented(rng, notice)}\n{commented(rng, notice)}", commented(rng, notice).upper()]
        rows += files
        want += [set(labels.split(","))] * len(files)
        other = rng.choice([k for k in NOTICES if k != labels])
        rows.append(f"{prose(rng, 50)}\n{commented(rng, notice)}\n{prose(rng, 200)}\n{NOTICES[other]}\n{prose(rng, 20)}")
        want.append(set(labels.split(",")) | set(other.split(",")))
    for text, labels in NOT_NOTICES.items():
        rows += [text, f"{prose(rng, 100)} {text} {prose(rng, 100)}"]
        want += [set(filter(None, labels.split(",")))] * 2
    got = op.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).orderBy("doc_id").collect()
    wrong = [(rows[r["doc_id"]][:60], r["labels"], w) for r, w in zip(got, want, strict=True) if set(filter(None, r["labels"].split(","))) != w]
    assert len(NOTICES) >= 20
    assert not wrong, "\n".join(map(str, wrong))


def test_a_changed_name_or_word_is_still_found_and_another_licence_is_not(spark):
    three = NOTICES["bsd-3-clause"]
    rows = [three.replace("Acme Works", "the Regents of a Rather Long Named University"), three.replace("COPYRIGHT HOLDERS AND CONTRIBUTORS", "AUTHOR"), NOTICES["mit"].replace("sublicense", "relicense")]
    got = op.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["labels"] for r in got] == ["bsd-3-clause", "bsd-3-clause", "mit"]


def test_whole_table_against_its_lines(spark):
    """The table's notices are single lines: each is found by a search for its words."""
    lines = {"gnu general public license version 3": "gpl-3.0", "apache license version 2 0": "apache-2.0", "cc by nc 4 0": "cc-by-nc-4.0", "all rights reserved": "proprietary"}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    found = op.op10_licenses(spark, SF).collect()
    assert len(found) == len(texts)
    for r in found:
        n, n_base, first, last, base = brute(texts[r["doc_id"]])
        joined = f" {' '.join(WORD.findall(lower(texts[r['doc_id']])))} "
        own = {label for line, label in lines.items() if f" {line} " in joined}
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (n, n_base, first, last, base)
        assert r["labels"] == ",".join(sorted({*filter(None, base.split(",")), *own}))
        assert r["score"] == 1.0 if n_base else r["score"] == (1.0 if own else 0.0)


def test_the_words_looked_up_are_each_files_rarest(spark):
    """With a word of the notice in every file its IDF is least, and a file that holds eight rarer ones isn't asked for it."""
    docs = spark.createDataFrame([(i, "merchantability " + ("x " * i)) for i in range(40)] + [(99, NOTICES["isc"])], "doc_id long, text string")
    counts, n = op.document_frequencies(docs)
    index = op.Index(op.TEMPLATES, counts, n)
    isc = index.ranked[[t.label for t in op.TEMPLATES].index("isc")]
    assert n == 41 and counts["merchantability"] == 41 and isc[-1] == "merchantability"
    assert op.scan(docs).where("labels <> ''").select("doc_id", "labels").collect() == [(99, "isc")]


def test_frequencies_are_of_all_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts, n = op.document_frequencies(docs)
    rows = [set(WORD.findall(lower(r["text"]))) for r in docs.collect()]
    assert n == len(rows)
    assert all(counts.get(w, 0) == sum(w in x for x in rows) for w in op.vocabulary())


def test_odd_rows(spark):
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    rows = [
        (1, None), (2, ""), (3, "  ...  "), (4, "MIT License"), (5, "mit license mit LICENSE"), (6, "cc-by CC BY cc_by"), (7, "apache licensed"),
        (8, "license"), (9, "a " * 20000 + "GNU General Public License"), (10, notice), (10, notice), (None, "Apache License"), (11, "Permission is hereby refused"),
        (12, "Licensed under the Apache License, Version 2.0"), (13, "All rights reserved."), (14, "gnu general public"), (15, "ÄMIT license é mit license"),
    ]
    df = spark.createDataFrame([(k, t, "x", 7) for k, t in rows], "doc_id long, text string, labels string, _words int")
    got = op.scan(df).collect()
    assert len(got) == len(rows)
    for k, t in rows:
        r = next(x for x in got if x["doc_id"] == k)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(t)
        assert 0 <= r["score"] <= 1
    labels = {r["doc_id"]: r["labels"] for r in got}
    assert labels[10] == "mit" and labels[12] == "apache,apache-2.0" and labels[11] == "" and labels[13] == "proprietary"


def test_empty_table(spark):
    assert op.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_main_path_is_native(spark):
    plan = op.op10_licenses(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
