"""Agreement of two rankings, as the acceptance threshold of 0.87 is defined."""


def overlap(expected: list[int], actual: list[int]) -> float:
    """Agreement of two rankings: 1 when equal, early places weigh most; 0 for an empty actual one against anything."""
    place = {x: i for i, x in enumerate(expected)}
    most = sum(4.0 ** -(i + 1) for i in range(len(actual)))
    got = sum(2.0 ** -(i + 1) * 2.0 ** -(place[x] + 1) for i, x in enumerate(actual) if x in place)
    return got / most if most else float(not expected)
