"""Parameters of the registered queries (FIXTURES.md section 3)."""

import datetime as dt

AS_OF_TASK = dt.date(1998, 6, 15)          # "today" for assignment queries
NOW_TASK = dt.datetime(1998, 6, 15, 12, 0)  # clock for day countdowns
AS_OF_ACTIVITY = dt.date(2024, 1, 30)       # "today" for the activity log
STUDENT_KEYWORD = "FuRn"
TEACHER_KEYWORD = "europe"
FILTER_JURUSAN = "build"
FILTER_KELAS = "_1"
FILTER_MAPEL = "ica"
FILTER_TEACHER_KELAS = "_2"
COURSE_KEYWORD = "an"
DAYS_SOON = 3
DAYS_CARD = 7
TOP_LOGS = 5
TOP_DAYS = 7
FILE_BASE_URL = "https://files.example.org/"
SUBJECT = "ASIA"
