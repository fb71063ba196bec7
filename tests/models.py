"""Plain sequential statements of what the distributed operators must compute."""

from __future__ import annotations

import statistics

import numpy as np

GRID = [867_569_000 + 100_000 * i for i in range(15)]


def ema(values, alpha):
    out, now = [], None
    for v in values:
        now = v if now is None else (1 - alpha) * now + alpha * v
        out.append(now)
    return out


def greedy_keep(times, interval):
    kept, last = [], None
    for t in times:
        if last is None or t - last >= interval:
            kept.append(t)
            last = t
    return kept


def clusters(regions, proximity):
    """regions: (seq, center, width, peak, avg, snr) in order -> final channels."""
    found = []
    for seq, center, width, peak, avg, snr in regions:
        best = None
        for ch in found:
            d = abs(ch["center"] - center)
            if d <= proximity and (best is None or d < abs(best["center"] - center)):
                best = ch
        if best is None:
            found.append(dict(id=len(found) + 1, center=center, width=width, peak=peak, avg=avg,
                              snr=snr, n=1))
            continue
        best["center"] = int(round(0.9 * best["center"] + 0.1 * center))
        best["width"] = int(round(0.9 * best["width"] + 0.1 * width))
        best["peak"] = round(max(best["peak"], peak), 3)
        best["avg"] = round(0.8 * best["avg"] + 0.2 * avg, 3)
        best["snr"] = round(0.8 * best["snr"] + 0.2 * snr, 3)
        best["n"] += 1
    return found


def merged(found, proximity):
    live = [dict(c) for c in found]
    gone = []
    for a in list(live):
        if a["id"] in gone:
            continue
        for b in live:
            if b["id"] <= a["id"] or b["id"] in gone:
                continue
            if abs(a["center"] - b["center"]) > max(proximity, (a["width"] + b["width"]) // 2):
                continue
            n = a["n"] + b["n"]
            a["center"] = int(round((a["center"] * a["n"] + b["center"] * b["n"]) / n))
            a["width"] = max(a["width"], b["width"])
            a["peak"] = max(a["peak"], b["peak"])
            a["snr"] = max(a["snr"], b["snr"])
            a["avg"] = round((a["avg"] + b["avg"]) / 2, 3)
            a["n"] = n
            gone.append(b["id"])
    return [c for c in live if c["id"] not in gone], gone


def tracks(frames, association, holdoff, n_frames):
    """frames: {frame: [(center, snr), ...]} -> closed tracks in closing order."""
    live, done = [], []
    for frame in range(n_frames):
        used = set()
        for center, snr in sorted(frames.get(frame, [])):
            choice, reach = None, association
            for i, t in enumerate(live):
                d = abs(t["now"] - center)
                if i not in used and d <= reach:
                    choice, reach = i, d
            if choice is None:
                live.append(dict(start=frame, centers=[], snr=snr))
                choice = len(live) - 1
            t = live[choice]
            used.add(choice)
            t["centers"].append(center)
            t["now"] = statistics.median(t["centers"])
            t["last"] = frame
            t["snr"] = max(t["snr"], snr)
        closed = [t for t in live if frame - t["last"] >= holdoff]
        live = [t for t in live if frame - t["last"] < holdoff]
        done += [(frame, t["start"], t["now"], len(t["centers"]), t["snr"]) for t in closed]
    return done


def spectra(iq, center, rate, size=2048, parts=4):
    """In-band short-time spectra of consecutive samples, and their frequencies."""
    n = size // parts
    out = []
    for f in range(len(iq) // size):
        power = 0.0
        for p in range(parts):
            x = iq[f * size + p * n : f * size + (p + 1) * n].astype(np.complex128)
            power = power + np.abs(np.fft.fftshift(np.fft.fft(x * np.hanning(n)))) ** 2 / parts
        out.append(10 * np.log10(power + 1e-20))
    freqs = np.fft.fftshift(np.fft.fftfreq(n, 1 / rate)) + center
    band = (freqs >= GRID[0] - 40_000) & (freqs <= GRID[-1] + 40_000)
    return freqs[band], np.array(out)[:, band] if out else np.empty((0, band.sum()))


def evidence(iq, center, rate, seed, threshold=12.0):
    """Bursts of one gap-free recording: (freq, start frame, frames, width, snr, noise)."""
    freqs, rows = spectra(iq, center, rate)
    step = freqs[1] - freqs[0]
    noise = np.percentile(rows[:seed], 20, axis=0)
    live, done = [], []
    for frame, row in enumerate(rows):
        hot = row >= noise + threshold
        used = set()
        edges = np.flatnonzero(np.diff(np.concatenate(([0], hot.astype(int), [0]))))
        for low, high in zip(edges[::2], edges[1::2]):
            part, lin = row[low:high], 10 ** (row[low:high] / 10)
            where = float((lin * freqs[low:high]).sum() / lin.sum())
            peak = int(np.argmax(part))
            snr = part[peak] - noise[low + peak]
            width = float((part >= part[peak] - 10).sum() * step)
            choice, reach = None, 15_000
            for i, t in enumerate(live):
                d = abs(t["now"] - where)
                if i not in used and d <= reach:
                    choice, reach = i, d
            if choice is None:
                live.append(dict(start=frame, centers=[], widths=[], snr=snr))
                choice = len(live) - 1
            t = live[choice]
            used.add(choice)
            t["centers"].append(where)
            t["widths"].append(width)
            t["now"] = statistics.median(t["centers"])
            t["last"], t["snr"] = frame, max(t["snr"], snr)
        for t in [t for t in live if frame - t["last"] >= 2]:
            at = int(np.argmin(np.abs(freqs - t["now"])))
            done.append((round(t["now"]), t["start"], len(t["centers"]),
                         round(statistics.median(t["widths"])), float(t["snr"]), float(noise[at])))
        live = [t for t in live if frame - t["last"] < 2]
        quiet = ~hot
        noise = np.where(quiet, noise + 0.02 * np.clip(row - noise, -3, 0.25), noise)
    return done
