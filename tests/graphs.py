"""Small random graphs as GFA text, with what is expected of them known from how they were made."""

import random
from dataclasses import dataclass


@dataclass
class Graph:
    """``segments`` are (name, sequence); ``walks`` are ((sample, phase, contig), steps), a step (segment, reversed). Generic paths come first."""

    segments: list
    walks: list
    header: str

    def text(self) -> str:
        lines = [self.header] + [f"S\t{n}\t{s}" for n, s in self.segments]
        for (sample, phase, contig), steps in self.walks:
            if sample is None:
                lines.append(f"P\t{contig}\t" + ",".join(self.segments[i][0] + "+-"[r] for i, r in steps) + "\t*")
            else:
                bp = sum(len(self.segments[i][1]) for i, _ in steps)
                lines.append(f"W\t{sample}\t{phase}\t{contig}\t0\t{bp}\t" + "".join("><"[r] + self.segments[i][0] for i, r in steps))
        return "\n".join(lines) + "\n"

    def ranges(self, node_bp: int) -> list[tuple[int, int]]:
        """The node ids of each segment, cut into nodes of so many base pairs."""
        out, at = [], 1
        for _, s in self.segments:
            out.append((at, at + -(-len(s) // node_bp)))
            at = out[-1][1]
        return out


def handles_of(walks: list) -> list:
    """Both orientations of walks of handles."""
    return walks + [[g ^ 1 for g in reversed(w)] for w in walks]


def random_graph(seed: int, named: bool) -> Graph:
    """Two chains of bubbles, a generic path and two haplotypes along each. With integer names one walk turns back; with other names a segment is unused."""
    rng = random.Random(seed)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    segments, chains = [], []
    for c in range(2):
        places = []
        for k in range(rng.randint(5, 7)):
            sides = 1 + k % 2  # anchors, and bubbles of two sides between them
            places.append(list(range(len(segments), len(segments) + sides)))
            segments += [dna(rng.randint(1, 2) if sides == 2 else rng.randint(3, 6)) for _ in range(sides)]
        if named and c == 0:
            segments.append(dna(3))
        chains.append(places)
    names = [f"part{i}{chr(97 + i % 7)}" if named else str(300 + 3 * i) for i in range(len(segments))]
    walks = [((None, 0, contig), [(p[0], False) for p in places]) for contig, places in zip("XY", chains)]
    for contig, places in zip("XY", chains):
        for phase in (1, 2):
            steps = [(rng.choice(p), False) for p in places]
            if not named and contig == "Y" and phase == 1:
                turn = rng.choice(places[1])
                steps = steps[:3] + [(turn, True), (places[0][0], True)]
            walks.append((("donor", phase, contig), steps))
    return Graph(list(zip(names, segments)), walks, "H\tVN:Z:1.1" + "\tRS:Z:donor" * named)


BUBBLES, CHOPPED = random_graph(21, named=False), random_graph(22, named=True)
#: Walks as lines of handles, one of them empty.
WALKS = "".join(",".join(map(str, w)) + "\n" for w in ([8, 10, 15], [8, 12, 15, 9], [], [20, 22], [8, 10, 15], [22, 21, 27]))
