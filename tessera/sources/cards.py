"""The card catalog: every record kind, its keyword and the fields of its cards."""

from __future__ import annotations

from dataclasses import dataclass

# Field layouts of the keyword format. A field is name, a letter for its type
# (i integer, d double, s text) and its width; "-" skips a width.
EIGHT_IDS = " ".join(f"n{i}:i8" for i in range(1, 9))
TEN_IDS = " ".join(f"id{i}:i10" for i in range(1, 9))
TEN_NUMBERS = " ".join(f"c{i}:d10" for i in range(1, 9))


@dataclass(frozen=True)
class Kind:
    """A record kind.

    ``keyword`` is a regular expression on the upper-cased keyword line. ``mode``: ``each``, every data
    line is a record; ``first``, only the first ``len(cards)`` lines of a section are one; ``group``, every
    ``len(cards)`` lines are one; ``list``, the first card heads a list made of all later lines.
    ``titled``: a title line comes first (``always``, or where the keyword ends in _TITLE or _ID).
    """

    keyword: str
    mode: str
    cards: tuple[str, ...]
    titled: str = ""
    types: tuple[tuple[str, str], ...] = ()


def _first(keyword: str, *cards: str, titled: str = "", types: tuple = ()) -> Kind:
    return Kind(keyword, "first", cards, titled, types)


CONTACT_TYPES = (
    "AUTOMATIC_SINGLE_SURFACE", "AUTOMATIC_SURFACE_TO_SURFACE", "AUTOMATIC_NODES_TO_SURFACE", "AUTOMATIC_GENERAL", "TIED_SURFACE_TO_SURFACE",
    "TIED_NODES_TO_SURFACE", "TIED_SHELL_EDGE_TO_SURFACE", "SURFACE_TO_SURFACE", "NODES_TO_SURFACE",
)
#: Material type -> names and numbers in keywords, and how many cards it has.
MATERIAL_TYPES = {
    "ELASTIC": (("ELASTIC", "001"), 1), "ORTHOTROPIC_ELASTIC": (("ORTHOTROPIC_ELASTIC", "002"), 2), "PLASTIC_KINEMATIC": (("PLASTIC_KINEMATIC", "003"), 1), "RIGID": (("RIGID", "020"), 3),
    "PIECEWISE_LINEAR_PLASTICITY": (("PIECEWISE_LINEAR_PLASTICITY", "024"), 2), "FABRIC": (("FABRIC", "034"), 4), "COMPOSITE_DAMAGE": (("COMPOSITE_DAMAGE", "054", "055"), 6),
    "LAMINATED_COMPOSITE_FABRIC": (("LAMINATED_COMPOSITE_FABRIC", "058"), 5), "COMPOSITE_FAILURE": (("COMPOSITE_FAILURE", "ENHANCED_COMPOSITE_DAMAGE", "059"), 5),
}
UNKNOWN_MATERIAL_CARDS = 10
ASCII_OUTPUTS = ("GLSTAT", "MATSUM", "NODOUT", "ELOUT", "RCFORC", "SECFORC", "SPCFORC")
JOINT_TYPES = ("SPHERICAL", "REVOLUTE", "CYLINDRICAL", "PLANAR", "UNIVERSAL", "TRANSLATIONAL")

KINDS: dict[str, Kind] = {
    "node": Kind(r"^\*NODE\s*$", "each", ("nid:i8 x:d16 y:d16 z:d16 tc:i8 rc:i8",)),
    "part": _first(r"^\*PART\s*$", "pid:i10 secid:i10 mid:i10 eosid:i10 hgid:i10 grav:i10 adpopt:i10 tmid:i10", titled="always"),
    "element_shell": Kind(r"^\*ELEMENT_SHELL", "each", (f"eid:i8 pid:i8 {EIGHT_IDS}",)),
    "element_solid": Kind(r"^\*ELEMENT_SOLID", "each", (f"eid:i8 pid:i8 {EIGHT_IDS}",)),
    "element_beam": Kind(r"^\*ELEMENT_BEAM", "each", (f"eid:i8 pid:i8 {EIGHT_IDS}",)),
    "set_node": Kind(r"^\*SET_NODE_LIST", "list", ("sid:i10 da1:d10 da2:d10 da3:d10 da4:d10 solver:s10", TEN_IDS), "suffix"),
    "set_part": Kind(r"^\*SET_PART_LIST", "list", ("sid:i10 da1:d10 da2:d10 da3:d10 da4:d10 solver:s10", TEN_IDS), "suffix"),
    "set_shell": Kind(r"^\*SET_SHELL", "list", ("sid:i10 da1:d10 da2:d10 da3:d10 da4:d10 solver:s10", TEN_IDS), "suffix"),
    "set_solid": Kind(r"^\*SET_SOLID", "list", ("sid:i10 da1:d10 da2:d10 da3:d10 da4:d10 solver:s10", TEN_IDS), "suffix"),
    "set_segment": Kind(r"^\*SET_SEGMENT", "list", ("sid:i10 da1:d10 da2:d10 da3:d10 da4:d10 solver:s10", "n1:i10 n2:i10 n3:i10 n4:i10"), "suffix"),
    "section_shell": _first(r"^\*SECTION_SHELL", "secid:i10 elform:i10 shrf:d10 nip:i10 propt:d10 qr_irid:i10 icomp:i10 setyp:i10", "t1:d10 t2:d10 t3:d10 t4:d10 nloc:d10 marea:d10 idof:d10 edgset:d10", titled="suffix"),
    "section_solid": _first(r"^\*SECTION_SOLID", "secid:i10 elform:i10 aet:i10", titled="suffix"),
    "section_beam": _first(r"^\*SECTION_BEAM", "secid:i10 elform:i10 shrf:d10 qr_irid:i10 cst:d10 scoor:d10", "ts1:d10 ts2:d10 tt1:d10 tt2:d10 nsloc:d10 ntloc:d10", titled="suffix"),
    "contact": _first(r"^\*CONTACT_", "ssid:i10 msid:i10 sstyp:i10 mstyp:i10 sboxid:i10 mboxid:i10 spr:i10 mpr:i10", "fs:d10 fd:d10 dc:d10 vc:d10 vdc:d10 penchk:i10 bt:d10 dt:d10", "sfs:d10 sfm:d10 sst:d10 mst:d10 sfst:d10 sfmt:d10 fsf:d10 vsf:d10", titled="suffix"),
    "material": Kind(r"^\*MAT_", "list", ("mid:i10 ro:d10 e:d10 pr:d10", TEN_NUMBERS), "suffix"),
    "include": Kind(r"^\*INCLUDE", "each", ("filepath:s400",)),
    "curve": Kind(r"^\*DEFINE_CURVE", "list", ("lcid:i10 sidr:i10 sfa:d10 sfo:d10 offa:d10 offo:d10 dattyp:i10", "a:d20 o:d20"), "suffix"),
    "boundary_spc": Kind(r"^\*BOUNDARY_SPC", "each", ("nid:i10 cid:i10 dofx:i10 dofy:i10 dofz:i10 dofrx:i10 dofry:i10 dofrz:i10",), types=(("SET", "SET"), ("", "NODE"))),
    "boundary_motion": Kind(r"^\*BOUNDARY_PRESCRIBED_MOTION", "each", ("nid:i10 dof:i10 vad:i10 lcid:i10 sf:d10 vid:i10 death:d10 birth:d10",), types=(("SET", "SET"), ("RIGID", "RIGID"), ("", "NODE"))),
    "load_node": Kind(r"^\*LOAD_NODE", "each", ("nid:i10 dof:i10 lcid:i10 sf:d10 cid:i10 m1:i10 m2:i10 m3:i10",), types=(("SET", "SET"), ("", "POINT"))),
    "load_segment": Kind(r"^\*LOAD_SEGMENT", "each", ("lcid:i10 sf:d10 at:d10 n1:i10 n2:i10 n3:i10 n4:i10",)),
    "load_body": _first(r"^\*LOAD_BODY_", "lcid:i10 sf:d10 lciddr:i10 xc:d10 yc:d10 zc:d10 cid:i10", types=(("BODY_X", "X"), ("BODY_Y", "Y"), ("BODY_Z", "Z"), ("", "OTHER"))),
    "control_termination": _first(r"^\*CONTROL_TERMINATION", "endtim:d10 endcyc:d10 dtmin:d10 endeng:d10 endmas:d10 nosol:i10"),
    "control_timestep": _first(r"^\*CONTROL_TIMESTEP", "dtinit:d10 tssfac:d10 isdo:i10 tslimt:d10 dt2ms:d10 lctm:i10 erode:i10 ms1st:i10"),
    "control_energy": _first(r"^\*CONTROL_ENERGY", "hgen:i10 rwen:i10 slnten:i10 rylen:i10"),
    "control_output": _first(r"^\*CONTROL_OUTPUT", "npopt:i10 netefm:i10 nflcit:i10 nprint:i10 ikedit:i10 iflush:i10 iprtf:i10 ierode:i10"),
    "control_shell": _first(r"^\*CONTROL_SHELL", "wrpang:d10 esort:i10 irnxx:i10 istupd:i10 theory:i10 bwc:i10 miter:i10 proj:i10"),
    "control_contact": _first(r"^\*CONTROL_CONTACT", "slsfac:d10 rwpnal:d10 islchk:i10 shlthk:i10 penopt:i10 thkchg:d10 otefm:i10 enmass:i10"),
    "control_hourglass": _first(r"^\*CONTROL_HOURGLASS", "ihq:i10 qh:d10"),
    "control_bulk_viscosity": _first(r"^\*CONTROL_BULK_VISCOSITY", "q1:d10 q2:d10 type:i10"),
    "database_binary": _first(r"^\*DATABASE_BINARY_D3(PLOT|THDT)", "dt:d10 lcdt:i10 beam:i10 npltc:i10 psetid:i10", types=(("D3PLOT", "D3PLOT"), ("D3THDT", "D3THDT"))),
    "database_ascii": _first(rf"^\*DATABASE_({'|'.join(ASCII_OUTPUTS)})", "dt:d10 lcdt:i10 binary:i10 lcur:i10 ioopt:i10", types=tuple((x, x) for x in ASCII_OUTPUTS)),
    "database_history": Kind(r"^\*DATABASE_HISTORY_(NODE|SHELL|SOLID|BEAM)", "list", ("", TEN_IDS), types=(("NODE", "NODE"), ("SHELL", "SHELL"), ("SOLID", "SOLID"), ("BEAM", "BEAM"))),
    "database_cross_section": _first(r"^\*DATABASE_CROSS_SECTION", "csid:i10 psid:i10 ssid:i10 tsid:i10 dsid:i10"),
    "initial_velocity_generation": _first(r"^\*INITIAL_VELOCITY_GENERATION", "nsid:i10 omega:d10 vx:d10 vy:d10 vz:d10 xc:d10 yc:d10 zc:d10"),
    "initial_velocity": _first(r"^\*INITIAL_VELOCITY(_SET|_NODE)?\s*$", "nsid:i10 nsidex:i10 boxid:i10 irigid:i10 vx:d10 vy:d10 vz:d10 vxr:d10", types=(("SET", "SET"), ("NODE", "NODE"), ("", "PLAIN"))),
    "nodal_rigid_body": _first(r"^\*CONSTRAINED_NODAL_RIGID_BODY", "pid:i10 cid:i10 nsid:i10 pnode:i10 iprt:i10 drflag:i10 rrflag:i10", types=(("INERTIA", "INERTIA"), ("", "PLAIN"))),
    "extra_nodes_set": Kind(r"^\*CONSTRAINED_EXTRA_NODES_SET", "each", ("pid:i10 nsid:i10",)),
    "extra_nodes": Kind(r"^\*CONSTRAINED_EXTRA_NODES(_NODE)?\s*$", "list", ("pid:i10", TEN_IDS)),
    "joint": _first(r"^\*CONSTRAINED_JOINT_", "n1:i10 n2:i10 n3:i10 n4:i10 n5:i10 n6:i10 rps:i10 damp:i10", types=(*((x, x) for x in JOINT_TYPES), ("", "OTHER"))),
    "spotweld": _first(r"^\*CONSTRAINED_SPOTWELD", "n1:i10 n2:i10 sn:d10 ss:d10 n:i10 m:i10 tf:d10"),
}


def fields(card: str) -> list[tuple[str, str, int, int]]:
    """(name, type letter, start, width) of a card's fields."""
    out, at = [], 0
    for item in card.split():
        name, _, kind = item.partition(":")
        width = int(kind[1:])
        if name != "-":
            out.append((name, kind[0], at, width))
        at += width
    return out
