"""Licence families are told apart: identifiers, neighbouring licences, unknown ones; secret offsets in long texts."""

import time

from pressline.llm import licences, secrets
from tests.llm.conftest import prose

#: notice -> the family, or None: no family may be confirmed
NOTICES = {
    "Licensed under CC BY-SA 4.0.": "cc-by-sa", "Licensed under CC BY-NC-SA 4.0.": None, "Licensed under CC BY 4.0.": "cc-by", "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc-by",
    "Licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 License.": None,
    "This program is licensed under the GNU Affero General Public License, version 3.": "agpl", "Licensed under the GNU Lesser General Public License.": "lgpl",
    "This work is licensed under the GNU General Public License, version 3.": "gpl", "Licensed under the GNU Free Documentation License.": "gfdl",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.": "isc",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software.": "mit",
    "This is free and unencumbered software released into the public domain.": "unlicense", "Dedicated to the public domain under CC0 1.0 Universal.": "cc0",
    "This program is made available under the terms of the Eclipse Public License 2.0.": "epl",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl", "Licensed under the Microsoft Public License.": "ms-pl",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.": "ofl", "Distributed under the Boost Software License, Version 1.0.": "boost",
    "SPDX-License-Identifier: QPL-1.0": None, "SPDX-License-Identifier: NotALicence": None, "Licensed under the Sleepycat License.": None, "Licensed under the Python Software Foundation License.": None,
    **{f"SPDX-License-Identifier: {i}": f for f, i in licences.IDENTIFIERS.items()},
}


def test_no_wrong_family_is_confirmed(spark):
    rows = [(k, f"{prose(k, 20)}\n\n{t}\n\n{prose(k + 9, 20)}") for k, t in enumerate(NOTICES)]
    rows += [(1000 + k, f"{prose(k, 12)} public {prose(k, 5)} version") for k in range(60)]
    got = {r.doc_id: r for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    wrong = {t: [(f.family, f.confirmed) for f in got[k].families] for k, (t, want) in enumerate(NOTICES.items()) for f in got[k].families if f.confirmed and f.family != want}
    assert not wrong
    named = [t for k, (t, want) in enumerate(NOTICES.items()) if want and any(f.confirmed and f.family == want for f in got[k].families)]
    lost = [t for t, want in NOTICES.items() if want and t not in named]
    assert len(lost) <= 4, lost
    seen = [k for k in range(len(NOTICES)) if got[k].families]
    assert len(seen) >= 0.85 * len(NOTICES)
    assert all(got[1000 + k].family == "none" for k in range(60))


def test_secret_offsets_are_linear():
    unit = "é password = abcdefgh12 "
    raw = (unit * 40_000).encode()
    began = time.monotonic()
    spans = secrets.scan_texts([raw])[0]
    assert time.monotonic() - began < 20
    assert len(spans) == 40_000 and spans[-1][1] == len(unit) * 39_999 + 2 and {s[2] - s[1] for s in spans} == {len("password = abcdefgh12")}
