from itertools import islice

import pytest

from threadloom.params import JoinParams, libc_rand


def test_generator_matches_the_published_sequence():
    assert list(islice(libc_rand(11110), 4)) == [1240634971, 1612665021, 850789632, 1882302984]


def test_generator_goes_on_past_its_ring():
    whole = list(islice(libc_rand(7), 9000))
    r = [7]
    for _ in range(30):
        r.append(16807 * r[-1] % 2147483647)
    r += r[:3]
    for i in range(34, 344 + 9000):
        r.append((r[i - 3] + r[i - 31]) % (1 << 32))
    assert whole == [x >> 1 for x in r[344 : 344 + 9000]]


def test_tables_have_their_sizes_and_runs():
    p = JoinParams(num_str=3, num_hash=4, num_bits=5, alphabet=5, k=6, shift=4, sampling_range=20)
    assert [len(x) for x in p.positions] == [5] * 4 and len(p.weights) == 5 and p.num_rep == 2
    assert p.last_position < 20
    for row in (r for t in p.walks for r in t):
        assert len(row) == p.last_position + 1
        assert all(row[i] == 0 or row[i] == 1 + (row[i + 1] if i + 1 < len(row) else 0) for i in range(len(row)))


@pytest.mark.parametrize("bad", [{"alphabet": 25}, {"sampling_range": 0}, {"k": -1}, {"k": 1000, "shift": 1}, {"min_pts": 0}])
def test_bad_parameters_are_refused(bad):
    with pytest.raises(ValueError):
        JoinParams(**bad)
