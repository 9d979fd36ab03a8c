import pytest

from gridloom import DateTime, Duration, Grid, Unit, View, cube_view

BOX = {"left": 5, "right": 10, "bottom": 48, "top": 53}


def view(t0, t1, dt, dx=0.01):
    return cube_view(extent={**BOX, "t0": t0, "t1": t1}, dt=dt, dx=dx, dy=dx)


def test_daily_and_monthly_views():
    v = view("2021-01-01", "2021-12-31", "P1D")
    assert (v.grid.nx, v.grid.ny, v.grid.nt) == (500, 500, 365)
    m = cube_view(v, dt="P1M")
    assert (m.grid.nx, m.grid.nt) == (500, 12)
    assert (m.grid.time(0).at.strftime("%Y-%m-%d"), m.grid.t1.last(Unit.DAY).at.strftime("%Y-%m-%d")) == ("2021-01-01", "2021-12-31")
    f = cube_view(m, nx=5000, ny=5000)
    assert f.grid.dx == pytest.approx(0.001) and f.grid.ny == 5000


@pytest.mark.parametrize(
    ("t0", "t1", "dt", "nt", "first", "last"),
    [
        ("2021-01-06", "2021-12-15", "P1M", 12, "2021-01-01", "2021-12-31"),
        ("2021-01", "2021-05", "P2M", 3, "2021-01-01", "2021-06-30"),
        ("2021-01", "2021-05", "P2Y", 1, "2021-01-01", "2022-12-31"),
        ("2021-01", "2021-05", "P1D", 151, "2021-01-01", "2021-05-31"),
        ("2021-01", "2021-05", "P2D", 76, "2021-01-01", "2021-06-01"),
        ("2018-01-01", "2018-01-10", "P3D", 4, "2018-01-01", "2018-01-12"),
    ],
)
def test_time_axes_grow_to_whole_steps(t0, t1, dt, nt, first, last):
    g = view(t0, t1, dt).grid
    assert g.nt == nt
    assert g.t0.at.strftime("%Y-%m-%d") == first
    assert g.t1.last(Unit.DAY).at.strftime("%Y-%m-%d") == last or g.unit == Unit.DAY and str(g.t1) == last


def test_space_grows_on_both_sides():
    g = Grid.of({"left": 0, "right": 10, "bottom": 0, "top": 10, "t0": "2021", "t1": "2021"}, dx=3, dy=3, dt="P1Y")
    assert (g.nx, g.left, g.right, g.dx) == (4, -1, 11, 3)


def test_datetimes():
    assert DateTime.parse("2021-01-31") + Duration.parse("P3M") == DateTime.parse("2021-04-30")
    assert DateTime.parse("2002-03-04").digits() == 20020304
    assert [DateTime.parse(x).unit for x in ("2002", "2002-03", "20020304", "2002-03-04T05", "2002-03-04 05:06", "2002-03-04T05:06:07Z")] == [Unit.YEAR, Unit.MONTH, Unit.DAY, Unit.HOUR, Unit.MINUTE, Unit.SECOND]
    assert DateTime.parse("2021-03-01").since(DateTime.parse("2021-01-15"), Unit.MONTH) == 2
    year, day = DateTime.parse("2021"), DateTime.parse("2021-01-01")
    assert not year == day and not year < day and year <= day and year >= day
    assert DateTime.parse("2024-03-03").day_of_week() == 0
    with pytest.raises(ValueError):
        DateTime.parse("20210")


def test_durations():
    assert str(Duration.parse("PT6H")) == "PT6H" and Duration.parse("P2W").unit == Unit.WEEK
    assert Duration.parse("P13M").convert(Unit.YEAR).n == 2
    assert Duration.parse("P45D").convert(Unit.MONTH).n == 2
    with pytest.raises(ValueError):
        Duration.parse("P1Y2M")


def test_views_as_json():
    v = view("2021-01-01", "2021-12-31", "P1M")
    assert View.from_json(v.to_json()) == v
    tile = View.from_json({"tile": {"x": 1, "y": 0, "z": 1}, "space": {}, "time": {"t0": "2021-01", "t1": "2021-03", "dt": "P1M"}})
    assert tile.grid.nx == 256 and tile.grid.left == pytest.approx(0) and tile.grid.top == pytest.approx(20037508.34, abs=1)
    assert View(v.grid, "nonsense", "nonsense").aggregation == "none"
