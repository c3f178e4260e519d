"""Hand-made meeting bundles (invented names) covering the gates and the
enrichment edge cases."""

from __future__ import annotations

import json
import os

ALL = ("summary.json", "meeting-info.json", "speakers.json", "events.json", "speaker-meta.json", "transcript.json")


def turn(i, speaker, sentence, sentiment="neutral", **extra):
    t = {"sentence": sentence, "speaker_name": speaker, "sentimentType": sentiment, "time": float(i * 10),
         "endTime": float(i * 10 + 8), "averageConfidence": 0.9, "index": i}
    t.update(extra)
    return t


def bundle(mid, title=None, emails=("ann.lee@aegiscloud.com", "tom@clientco.com"), invitees=("a", "b", "c"),
           host="ann.lee@aegiscloud.com", items=(), topics=(), moments=(), turns=(), meta=None, score=3.5,
           drop_title=False, start="2026-02-06T09:15:00.000Z", end="2026-02-06T10:00:00.000Z", duration=45.0):
    info = {"meetingId": mid, "organizerEmail": host, "host": host, "startTime": start, "endTime": end,
            "duration": duration, "allEmails": list(emails), "invitees": list(invitees) if invitees is not None else None}
    if invitees is None:
        del info["invitees"]
    if not drop_title:
        info["title"] = title
    summ = {"meetingId": mid, "summary": f"Summary of {title}", "actionItems": list(items), "topics": list(topics),
            "overallSentiment": "positive", "sentimentScore": score, "keyMoments": list(moments)}
    speakers = [{"speakerName": "x", "timestamp": 1.0, "endTimeTs": 2.0}]
    events = [{"participantName": "x", "timestamp": 1770000000000, "type": "Join", "time": 0.0}]
    if meta is None:
        meta = {str(i): s for i, s in enumerate(sorted({t["speaker_name"] for t in turns if "speaker_name" in t}))}
    return {"meeting-info.json": info, "summary.json": summ, "speakers.json": speakers, "events.json": events,
            "speaker-meta.json": meta, "transcript.json": {"data": list(turns)}}


def write(root, folder, files, skip=(), broken=()):
    d = os.path.join(root, folder)
    os.makedirs(d, exist_ok=True)
    for name, content in files.items():
        if name in skip:
            continue
        with open(os.path.join(d, name), "w") as f:
            if name in broken:
                f.write('{"oops": [1, 2,, }')
            else:
                json.dump(content, f)


def make_bundles(root: str) -> None:
    full_turns = [
        turn(0, "Ann Lee", "Hello, thanks for joining. We are frustrated with billing.", "negative"),
        turn(1, "Tom Fisk", "We compared Okta and Duo last week; okta-style SSO matters.", "negative"),
        turn(2, "Ann Lee", "Aegis Identity handles that, and Detect too.", "neutral"),
        turn(3, "Tom Fisk", "Pinging you later about compliance and Aegis Compliance.", "neutral"),
        turn(4, "Support Agent", "Entra sync is broken for us.", "negative"),
        turn(5, "Tom Fisk", "Shipping the fix would help; identity matters.", "positive"),
        turn(6, "Ann Lee", "Great, sentinel covers it.", "positive"),
        turn(7, "Tom Fisk", "Thanks!", "positive"),
        turn(8, "Ann Lee", "Bye.", "positive"),
    ]
    items = [
        "Ann Lee: Submit billing adjustment by Friday",
        "no owner here, finish this week",
        ": blank owner next week",
        "Tom Fisk: confirm within 5 business days and by friday",
        "Ops: a: b before the March billing cycle",
        "Ann Lee: a very long task description that goes well beyond forty characters",
    ]
    topics = ["Billing dispute", "Okta migration", "Billing dispute", "Aegis Detect", "Feature request"]
    moments = [{"time": 12, "text": "churn risk", "type": "churn_signal", "speaker": "Tom Fisk"},
               {"time": 3.5, "text": "praise", "type": "praise", "speaker": "Ann Lee"}]
    meta = {"0": "Ann Lee", "1": "Tom Fisk", "2": "Silent Observer"}
    write(root, "m01_complete", bundle("M01", "Crestline Wealth Group Renewal", items=items, topics=topics,
                                       moments=moments, turns=full_turns, meta=meta, score=4.5))
    base = bundle("MX", "Missing")
    for i, name in enumerate(ALL):
        write(root, f"m1{i}_missing_{name.split('.')[0]}", bundle(f"MM{i}", "Missing"), skip=(name,))
    write(root, "m20_broken_events", bundle("M20", "Broken"), broken=("events.json",))
    write(root, "m21_broken_summary", bundle("M21", "Broken 2"), broken=("summary.json",))
    write(root, "m22_domain_only", bundle("M22", "Quarterly review", emails=("a@gmail.com", "b@ironworkscorp.com"),
                                          turns=[turn(0, "b", "hi"), turn(1, "a", "hello")]))
    write(root, "m23_ignored_only", bundle("M23", "Quarterly review", emails=("a@gmail.com", "b@aegis.io", "nope")))
    write(root, "m24_hyphen_digit", bundle("M24", "Partner call", emails=("x@foo-bar3.io",)))
    write(root, "m25_host_no_at", bundle("M25", "Partner call", host="ann", emails=("ann@client.com", "zed@client.com"),
                                         turns=[turn(0, "Ann", "hi"), turn(1, "Zed", "yo"), turn(2, "Bo", "x")]))
    write(root, "m26_empty_speaker", bundle("M26", "Support Case #42 - Summit Trust",
                                            turns=[turn(0, "", "something"), turn(1, "Tom", "ping me")]))
    write(root, "m27_one_invitee", bundle("M27", "Renewal Summit Trust", invitees=("a",), score=None,
                                          turns=[turn(i, "Tom" if i % 2 else "Ann Lee", f"s{i}", s)
                                                 for i, s in enumerate(["negative", "positive", "negative"])]))
    write(root, "m28_no_invitees", bundle("M28", "Helix Data chat", invitees=None, score=1.0,
                                          turns=[turn(0, "Tom", "only one")]))
    write(root, "m29_two_turns", bundle("M29", "Team Sync internal", score=5.0,
                                        turns=[turn(0, "Tom", "a"), turn(1, "Ann Lee", "b")]))
    write(root, "m30_no_title", bundle("M30", None, drop_title=True, items=["Zed: done by Friday"],
                                       topics=["Okta"], turns=[turn(0, "Zed", "hello okta", sentiment="positive")]))
    write(root, "m31_absent_fields", bundle("M31", "Wrap-up meeting", turns=[{"index": 0}, {"sentence": "x", "index": 1}],
                                            start=""))
    os.makedirs(os.path.join(root, "m40_empty_folder"), exist_ok=True)
    nan = bundle("M41", "Partner call", score=float("nan"), duration=float("inf"),
                 turns=[turn(0, "Tom", "a", time=float("nan")), turn(1, "Ann Lee", "b", averageConfidence=float("-inf"))])
    write(root, "m41_nan", nan)
    del base
