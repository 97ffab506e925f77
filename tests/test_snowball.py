"""Snowball stemmers against pairs of the algorithms' published sample vocabularies, and the filter in a chain."""

from __future__ import annotations

import pytest

from quarry.functions import analysis, snowball, stemmers  # noqa: F401

PAIRS = {
    "english": "consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist consisting consist consists consist consolation consol consolations consol consolatory consolatori consolidate consolid consolidated consolid consolidating consolid consoling consol consolingly consol consols consol consonant conson knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knead knead kneel kneel kneeled kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knives knive knob knob knocked knock knocker knocker knocking knock knopp knopp knot knot knots knot hopping hop hoping hope generally general communication communic skies sky dying die news news cries cri ties tie say say gas gas gaps gap this this kiwis kiwi succeed succeed",
    "german": "aufeinanderfolge aufeinanderfolg kategorie kategori kategorien kategori kategorischen kategor kater kat katers kat katze katz katzen katz kätzchen katzch aufenthalt aufenthalt aufenthalte aufenthalt auffassung auffass häusern haus bedürfnissen bedurfnis",
    "swedish": "jakt jakt jakten jakt jakthund jakthund klostergården klostergård klosterkyrkan klosterkyrkan",
    "norwegian": "havnedistrikt havnedistrikt havnedistriktene havnedistrikt havnedistrikter havnedistrikt opning opning opningen opning",
    "danish": "indtage indtag indtagelse indtag indtager indtag undersøgelser undersøg underholdning underholdning",
}


@pytest.mark.parametrize("language", sorted(PAIRS))
def test_pairs(language):
    words = PAIRS[language].split()
    fn = snowball.STEMMERS[language]
    assert [(w, fn(w)) for w in words[::2]] == list(zip(words[::2], words[1::2], strict=True))
    assert [fn(w) for w in ("", "a", "x")] == ["", "a", "x"]


def test_filter():
    a = analysis.build("whitespace", ["lowercase", ("snowball", {"language": "english"})])
    assert a.terms("Consistently Dying Knightly") == ["consist", "die", "knight"]
    assert analysis.build("whitespace", [("snowball", {"language": "porter"})]).terms("generally") == ["gener"]
    assert analysis.build("whitespace", [("snowball", {"language": "french"})]).terms("chevaux")
