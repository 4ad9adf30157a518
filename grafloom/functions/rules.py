"""Keyword tables of the semantic graph layers, in the order in which they apply."""

from __future__ import annotations

#: Terms and what they mean.  "sa thái" is how the first keyword lists spell "sa thải"; both are matched, and both give
#: the same ids.
TERMS = (
    ("người lao động", "Người làm việc cho người sử dụng lao động theo thỏa thuận, được trả lương và chịu sự quản lý, điều hành, giám sát."),
    ("người sử dụng lao động", "Doanh nghiệp, cơ quan, tổ chức, hợp tác xã, hộ gia đình, cá nhân có thuê mướn, sử dụng lao động làm việc cho mình theo thỏa thuận."),
    ("hợp đồng lao động", "Sự thỏa thuận giữa người lao động và người sử dụng lao động về việc làm có trả công, tiền lương, điều kiện lao động, quyền và nghĩa vụ của mỗi bên."),
    ("thử việc", "Thỏa thuận về việc làm thử, quyền và nghĩa vụ của hai bên trong thời gian thử việc."),
    ("tiền lương", "Số tiền mà người sử dụng lao động trả cho người lao động để thực hiện công việc theo thỏa thuận."),
    ("lương tối thiểu", "Mức lương thấp nhất được trả cho người lao động làm công việc giản đơn nhất trong điều kiện lao động bình thường."),
    ("kỷ luật lao động", "Những quy định về việc tuân theo thời gian, công nghệ và điều hành sản xuất, kinh doanh do người sử dụng lao động ban hành."),
    ("sa thái", "Hình thức xử lý kỷ luật sa thái đối với người lao động có hành vi vi phạm nghiêm trọng."),
    ("sa thải", "Hình thức xử lý kỷ luật sa thái đối với người lao động có hành vi vi phạm nghiêm trọng."),
    ("trợ cấp thôi việc", "Khoản trợ cấp trả cho người lao động đã làm việc thường xuyên từ đủ 12 tháng trở lên khi chấm dứt hợp đồng lao động hợp pháp."),
    ("trợ cấp mất việc làm", "Khoản trợ cấp trả cho người lao động đã làm việc thường xuyên từ đủ 12 tháng trở lên bị mất việc làm do thay đổi cơ cấu, công nghệ."),
    ("bảo hiểm xã hội", "Sự bảo đảm thay thế hoặc bù đắp một phần thu nhập của người lao động khi họ bị giảm hoặc mất thu nhập do ốm đau, thai sản, tai nạn lao động, bệnh nghề nghiệp, hết tuổi lao động hoặc chết."),
    ("công đoàn", "Tổ chức chính trị - xã hội rộng lớn của giai cấp công nhân và của người lao động được thành lập trên cơ sở tự nguyện."),
)
CALCULATED = ("tính", "công thức", "mức hưởng", "bình quân", "phần trăm")
FORMULAS = (
    ("tiền lương làm thêm giờ", "Cách tính lương làm thêm giờ"),
    ("trợ cấp thôi việc", "Cách tính trợ cấp thôi việc"),
    ("trợ cấp mất việc", "Cách tính trợ cấp mất việc làm"),
    ("thai sản", "Mức hưởng chế độ thai sản"),
    ("hưu trí", "Cách tính lương hưu"),
    ("lương tối thiểu", "Áp dụng lương tối thiểu vùng"),
)
SUBJECTS = (
    ("người lao động", "chuthe:nguoi-lao-dong"),
    ("người sử dụng lao động", "chuthe:nguoi-su-dung-lao-dong"),
    ("công đoàn", "chuthe:cong-doan"),
    ("thanh tra lao động", "chuthe:thanh-tra-lao-dong"),
    ("bảo hiểm xã hội", "chuthe:co-quan-bhxh"),
)
CONTRACTS = (
    ("không xác định thời hạn", "hopdong:khong-xac-dinh-thoi-han"),
    ("xác định thời hạn", "hopdong:xac-dinh-thoi-han"),
    ("thử việc", "hopdong:thu-viec"),
)
ACTIONS = ("sa thái", "sa thải", "đi muộn", "nghỉ việc", "thai sản", "tai nạn lao động", "khấu trừ lương", "đơn phương chấm dứt")
BENEFITS = ("lương tăng ca", "trợ cấp thôi việc", "trợ cấp mất việc", "trợ cấp thai sản", "bồi thường tai nạn", "lương hưu")
FORBIDDEN = ("nghiêm cấm", "không được", "bị cấm", "trái pháp luật")
TIMED = ("kể từ", "thời hiệu", "thời hạn")
EVENTS = (
    ("chấm dứt hợp đồng", "Sự kiện: Chấm dứt hợp đồng"),
    ("quyết định kỷ luật", "Sự kiện: Kỷ luật lao động"),
    ("sinh con", "Sự kiện: Sinh con"),
    ("tai nạn", "Sự kiện: Tai nạn lao động"),
)
PROCESS = ("thủ tục", "hồ sơ", "giải quyết chế độ", "đơn đề nghị")
PROCEDURES = (
    ("trợ cấp thất nghiệp", "Thủ tục nhận trợ cấp thất nghiệp"),
    ("bảo hiểm xã hội một lần", "Thủ tục rút BHXH 1 lần"),
    ("đăng ký nội quy", "Thủ tục đăng ký nội quy lao động"),
    ("chế độ thai sản", "Thủ tục hưởng chế độ thai sản"),
)
DOSSIERS = (
    ("sổ bảo hiểm xã hội", "Sổ bảo hiểm xã hội"),
    ("sổ bhxh", "Sổ BHXH"),
    ("quyết định thôi việc", "Quyết định thôi việc/chấm dứt HĐLĐ"),
    ("đơn đề nghị", "Đơn đề nghị hưởng chế độ"),
    ("nội quy lao động", "Văn bản nội quy lao động"),
)
CONDITIONS = (
    ("đóng đủ 12 tháng", "Điều kiện đóng bảo hiểm từ đủ 12 tháng trở lên"),
    ("nghỉ việc đủ 1 năm", "Điều kiện nghỉ việc đủ 1 năm không đóng tiếp"),
    ("có từ 10 lao động", "Điều kiện sử dụng từ 10 lao động trở lên"),
)
AGENCIES = (
    ("cơ quan bảo hiểm xã hội", "Cơ quan Bảo hiểm xã hội"),
    ("trung tâm dịch vụ việc làm", "Trung tâm dịch vụ việc làm"),
    ("sở lao động", "Sở Lao động - Thương binh và Xã hội"),
    ("tòa án", "Tòa án nhân dân"),
)
#: Stages that a mention starts: any of the keywords, stage, evidence (a node's label is added where it ends with "tại ").
LIFECYCLE = (
    (("thử việc",), "lifecycle_nld:thu-viec", "Quy định thử việc tại "),
    (("ký hợp đồng", "ký kết hợp đồng"), "lifecycle_nld:ky-hdld", "Quy định ký hợp đồng tại "),
    (("đóng bảo hiểm", "đóng bhxh"), "lifecycle_nld:lam-viec", "Nghĩa vụ đóng bảo hiểm xã hội"),
    (("đóng bảo hiểm", "đóng bhxh"), "lifecycle_dn:dong-bhxh", "Nghĩa vụ đóng BHXH của DN"),
    (("nội quy lao động",), "lifecycle_dn:ban-hanh-noi-quy", "Ban hành nội quy lao động"),
)
EMPLOYEE_STAGES = (
    ("tuyen-dung", "Tuyển dụng", "Giai đoạn bắt đầu tìm kiếm và tuyển chọn nhân sự."),
    ("thu-viec", "Thử việc", "Giai đoạn thử thách, kiểm tra tay nghề và mức độ phù hợp."),
    ("ky-hdld", "Ký HĐLĐ chính thức", "Giai đoạn xác lập quan hệ lao động chính thức bằng văn bản."),
    ("lam-viec", "Làm việc & Hưởng chế độ", "Giai đoạn thực hiện công việc và nhận lương, BHXH, công đoàn."),
    ("thai-san-om-dau", "Thai sản / Ốm đau", "Giai đoạn nghỉ hưởng chế độ bảo hiểm xã hội."),
    ("cham-dut-hdld", "Chấm dứt HĐLĐ", "Giai đoạn dừng quan hệ lao động (hợp pháp hoặc đơn phương)."),
    ("nghi-huu", "Nghỉ hưu", "Giai đoạn kết thúc độ tuổi lao động và hưởng lương hưu."),
)
COMPANY_STAGES = (
    ("thanh-lap", "Thành lập", "Giai đoạn bắt đầu thành lập doanh nghiệp."),
    ("tuyen-dung-ld", "Tuyển dụng lao động", "Giai đoạn tuyển dụng nhân sự."),
    ("khai-bao-ld", "Khai báo sử dụng lao động", "Khai báo tình hình sử dụng lao động với cơ quan quản lý."),
    ("thang-bang-luong", "Xây dựng thang bảng lương", "Xây dựng hệ thống thang lương, bảng lương."),
    ("ban-hanh-noi-quy", "Ban hành nội quy", "Xây dựng và đăng ký nội quy lao động."),
    ("dong-bhxh", "Đóng bảo hiểm xã hội", "Đóng bảo hiểm xã hội bắt buộc cho người lao động."),
    ("giai-the", "Giải thể / Phá sản", "Chấm dứt hoạt động của doanh nghiệp."),
)
RISKS = (
    ("ruiro:thap", "Mức độ rủi ro: Thấp", "Nhắc nhở hoặc phạt hành chính nhẹ."),
    ("ruiro:vua", "Mức độ rủi ro: Vừa", "Phạt tiền hành chính ở mức trung bình."),
    ("ruiro:nghiem-trong", "Mức độ rủi ro: Nghiêm trọng", "Bồi thường thiệt hại lớn, đình chỉ hoạt động hoặc xử lý hình sự."),
)
#: The document that holds what belongs to no other: id, title, number, kind, issuer, text.
SYSTEM = ("he-thong", "Hệ thống tri thức số", "SYS", "Hệ thống", "Hệ thống", "Định nghĩa và thực thể hệ thống phục vụ cho đa tầng GraphRAG.")
#: The state that ends a limitation period.
LAPSED = ("trangthai:het-thoi-hieu-khoi-kien", "Hết thời hiệu khởi kiện", "Trạng thái pháp lý: Quá hạn thời hiệu khởi kiện của vụ việc.")
#: Kinds of nodes, and what stands before a name in a node's text, by what the node is.
KINDS = {
    "term": ("ThuậtNgữ", ""),
    "formula": ("CáchTính_CôngThức", "Phương pháp/cách tính "),
    "share": ("ThamSố_ConSố", "Mức tỷ lệ phần trăm quy định: "),
    "span": ("ThamSố_ConSố", "Mốc thời gian luật định: "),
    "subject": ("ChủThể", "Chủ thể pháp lý lao động: "),
    "contract": ("HợpĐồngLaoĐộng", "Loại hợp đồng lao động: "),
    "action": ("HànhVi_SựKiện", "Hành vi/Sự kiện thực tế: "),
    "benefit": ("ChếĐộ_QuyềnLợi", "Chế độ/Quyền lợi được hưởng: "),
    "event": ("SựKiệnKíchHoạt", "Sự kiện kích hoạt mốc thời gian: "),
    "date": ("MốcThờiGian_LuậtĐịnh", "Mốc thời gian luật định: "),
    "state": ("TrạngTháiPhápLý", ""),
    "procedure": ("ThủTục_ChếĐộ", "Quy trình thực hiện: "),
    "dossier": ("HồSơ_GiấyTờ", "Giấy tờ cần chuẩn bị: "),
    "condition": ("ĐiềuKiện", "Điều kiện đáp ứng: "),
    "agency": ("CơQuanGiảiQuyết", "Thẩm quyền giải quyết: "),
    "violation": ("HànhViDoanhNghiệp", "Hành vi vi phạm của doanh nghiệp: "),
    "fix": ("BiệnPhápKhắcPhục", "Biện pháp khắc phục hậu quả: "),
    "precedent": ("ÁnLệ", "Án lệ/Bản án thực tế của Tòa án nhân dân tối cao: "),
    "fact": ("TìnhTiếtCốtLõi", "Tình tiết cốt lõi vụ án: "),
    "ruling": ("PhánQuyết", "Phán quyết của Tòa án đối với hành vi "),
}
PUNISHED = ("phạt tiền", "bị phạt", "vi phạm", "nghiêm cấm")
SEVERE = ("hình sự", "truy cứu", "đình chỉ")
VIOLATIONS = (
    ("không đăng ký nội quy lao động", "Không đăng ký nội quy lao động"),
    ("không đóng bảo hiểm xã hội", "Không đóng bảo hiểm xã hội bắt buộc"),
    ("phạt tiền thay kỷ luật", "Phạt tiền thay cho xử lý kỷ luật"),
    ("thử việc quá 2 lần", "Ký hợp đồng thử việc quá 02 lần"),
    ("sa thái lao động mang thai", "Sa thái trái pháp luật lao động mang thai"),
    ("sa thải lao động mang thai", "Sa thái trái pháp luật lao động mang thai"),
)
FIXES = (
    ("truy đóng bhxh", "Truy đóng đủ số tiền bảo hiểm xã hội"),
    ("nhận lại người lao động", "Nhận người lao động trở lại làm việc và bồi thường"),
    ("quy chế đối thoại", "Xây dựng và thực hiện quy chế đối thoại"),
    ("hoàn trả tiền", "Hoàn trả tiền hoặc tài sản đã phạt trái luật"),
)
PRECEDENT = r"(?iuU)(Án lệ số \d+/20\d\d/AL|Án lệ số \d+|Bản án số \d+/20\d\d/[A-ZĐ0-9\-]+)"
FACTS = (
    ("tranh chấp học nghề", "Tranh chấp về hợp đồng học nghề"),
    ("sa thái trái pháp luật", "Sa thái người lao động trái luật"),
    ("sa thải trái pháp luật", "Sa thái người lao động trái luật"),
    ("đơn phương chấm dứt hợp đồng lao động", "Đơn phương chấm dứt hợp đồng lao động trái pháp luật"),
    ("nợ lương", "Doanh nghiệp chậm trả/nợ lương người lao động"),
)
