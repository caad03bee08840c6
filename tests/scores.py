"""Small score files and projects built from rows, for the tests."""

import io
import zipfile


def note(duration, pitch=None, chord=False, grace=False, rest=False, ties=(), voice="1", staff=None, tuplet=None, x=None, y=None):
    attrs = "".join(f' {k}="{v}"' for k, v in (("default-x", x), ("default-y", y)) if v is not None)
    body = "<grace/>" if grace else ""
    body += "<chord/>" if chord else ""
    if rest:
        body += "<rest/>"
    elif pitch == "unpitched":
        body += "<unpitched/>"
    elif pitch:
        step, alter, octave = pitch
        body += f"<pitch><step>{step}</step>" + (f"<alter>{alter}</alter>" if alter else "") + f"<octave>{octave}</octave></pitch>"
    body += f"<duration>{duration}</duration>" if not grace else ""
    body += "".join(f'<tie type="{t}"/>' for t in ties) + f"<voice>{voice}</voice>"
    if tuplet:
        body += f"<time-modification><actual-notes>{tuplet[0]}</actual-notes><normal-notes>{tuplet[1]}</normal-notes></time-modification>"
    if staff:
        body += f"<staff>{staff}</staff>"
    return f"<note{attrs}>{body}</note>"


def move(kind, duration):
    return f"<{kind}><duration>{duration}</duration></{kind}>"


def measure(number, *content, divisions=None, time=None, symbol=None, implicit=False, width=None, printed="", bar="", staves=None):
    attrs = f' number="{number}"' + (' implicit="yes"' if implicit else "") + (f' width="{width}"' if width else "")
    inner = f"<divisions>{divisions}</divisions>" if divisions else ""
    if time:
        inner += f"<time{f' symbol={chr(34)}{symbol}{chr(34)}' if symbol else ''}><beats>{time[0]}</beats><beat-type>{time[1]}</beat-type></time>"
    inner += f"<staves>{staves}</staves>" if staves else ""
    head = f"<attributes>{inner}</attributes>" if inner else ""
    return f"<measure{attrs}>{printed}{head}{''.join(content)}{bar}</measure>"


def score(*parts, defaults=""):
    body = "".join(f'<part id="P{i + 1}">{"".join(ms)}</part>' for i, ms in enumerate(parts))
    return f'<?xml version="1.0"?><score-partwise>{defaults}{body}</score-partwise>'.encode()


def zipped(**members):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for name, content in members.items():
            archive.writestr(name, content)
    return buffer.getvalue()


def zipped_names(members):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for name, content in members:
            archive.writestr(name, content)
    return buffer.getvalue()
