"""Golden names, and the catalogs the checks are built from."""

from checks.derived import CATALOGS  # noqa: F401

# Raw names with the field name they must get.
SNAKE = {
    "Stadium_ID": "stadium_i_d", "Name": "name_val", "GNPOld": "g_n_p_old", "%_Change_2007": "change_2007",
    "Official_ratings_(millions)": "official_ratings", "Home Town": "home_town", "Year": "year_val", "Capacity": "capacity",
    "18_49_Rating_Share": "col_18_49_rating_share", "": "col_", "Player's Name": "players_name", "a-b.c/d\\e": "a_b_c_d_e",
    "SourceAirport": "source_airport", "(all)": "col_", "__x__": "x",
}
ACRONYM = {"Stadium_ID": "stadium_id", "GNPOld": "gnp_old", "SourceAirport": "source_airport", "Name": "name_val"}
