"""Generated documents without labels hold nothing that a detector finds."""

import re

from mossveil.sources import synthetic

LANDLINE = re.compile(r"(?<!\d)0(?:2|3[1-3]|4[1-4]|5[1-5]|6[1-4]|70|50\d?)[-.\s]?\d{3,4}[-.\s]?\d{4}(?!\d)")


def test_no_distractor_is_a_phone_number():
    texts = [(n, text) for n in range(15_000) for text, labels, _ in [synthetic.document(42, n)] if not labels]
    assert texts and [n for n, text in texts if LANDLINE.search(text)] == []
