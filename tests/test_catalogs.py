"""Sizes and a few rows of the fixed tables, which the SQL checks share with the engine."""

from threatloom.catalogs import attack, code, pci


def test_sizes():
    assert len(attack.techniques()) == 34 and len(attack.TACTICS) == 12
    assert len(pci.REQUIREMENTS) == 12 and len(pci.sub_requirements()) == 64
    assert sum(s["relevant"] for s in pci.sub_requirements()) == 58
    assert len(code.PATTERNS) == 10


def test_rows():
    techniques = {t["technique_id"]: t for t in attack.techniques()}
    assert techniques["T1550"]["platforms"] == ["Linux", "Windows", "Cloud"]
    assert techniques["T1110"]["mitigation"] == ["Account lockout", "MFA", "Password policies"]
    subs = {s["sub_id"]: s for s in pci.sub_requirements()}
    assert not subs["12.3.1"]["relevant"] and subs["10.2.1.4"]["req_id"] == "10"
