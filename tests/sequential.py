"""Small sequential models the distributed operators are compared with."""

from difflib import SequenceMatcher


def greedy_keep(records, threshold):
    """records: (seq, key or None, name) in order -> (kept seqs, rep of each seq)."""
    kept, reps = [], {}
    for seq, key, name in records:
        rep = next((s for s, k, _ in kept if key and k == key), None)
        if rep is None:
            rep = next(
                (s for s, _, n in kept
                 if SequenceMatcher(None, name, n).ratio() >= threshold),
                None,
            )
        if rep is None:
            kept.append((seq, key, name))
            rep = seq
        reps[seq] = rep
    return [k[0] for k in kept], reps
